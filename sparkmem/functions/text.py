"""Text functions as column expressions; what needs a program is an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stop words of search terms, of sentence keys and of token weights, corrections of typing errors, synonyms.
STOP_WORDS = ["the", "a", "an", "is", "in", "on", "at", "to", "for", "of", "and", "or"]
KEY_STOP_WORDS = [
    "what", "is", "was", "were", "are", "am", "the", "a", "an", "in", "on", "at", "for", "of", "and", "or", "to", "her", "his", "its", "did", "does", "do", "has", "have", "had", "when", "where", "why", "who", "how", "which",
    "that", "this", "these", "those", "it", "they", "them", "he", "she", "we", "you", "i", "my", "your", "our", "their", "be", "been", "being", "by", "with", "from", "as", "if", "into", "about", "during", "before", "after",
]
COMMON_WORDS = [
    "the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "with", "is", "it", "of", "as", "by", "that", "this", "from", "how", "what", "why", "who", "where", "when", "does", "do", "can", "be", "are",
    "que", "de", "la", "el", "en", "un", "una", "y", "o", "por", "para", "con", "es", "los", "las", "del", "al", "como", "se", "su", "sus",
]
TYPOS = {"hiso": "hizo", "ase": "hace", "despliege": "despliegue", "revisar": "revisión", "implemento": "implementación", "habian": "habían", "erro": "error", "fallo": "falló"}
SYNONYMS = {
    "worktree": ["workspace", "entorno"],
    "workspace": ["worktree", "entorno"],
    "test": ["tests", "pruebas", "verificación"],
    "tests": ["test", "pruebas", "verificación"],
    "prueba": ["pruebas", "tests", "verificación"],
    "pruebas": ["prueba", "tests", "verificación"],
    "config": ["configuración", "settings"],
    "configuracion": ["config", "configuración"],
    "deploy": ["despliegue", "publicación"],
    "despliegue": ["deploy", "publicación"],
    "auth": ["autenticación", "autorización"],
    "authz": ["autorización", "permisos"],
    "mcp": ["protocolo", "herramientas"],
    "rag": ["retrieval", "recuperación", "búsqueda"],
}


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}_]+)"), 1)


def search_terms(text: Column, stop: list[str] = STOP_WORDS, least: int = 2) -> Column:
    """Distinct terms of so many characters that aren't stop words."""
    return F.array_distinct(F.filter(terms(text), lambda t: (F.char_length(t) >= least) & ~t.isin(*stop)))


def key_terms(text: Column) -> Column:
    """Distinct terms of a question to sentence keys: all but interrogatives and auxiliaries."""
    return search_terms(text, KEY_STOP_WORDS, least=1)


def sanitised(query: Column) -> Column:
    """A query without operators of the index language, its words joined by AND."""
    plain = F.translate(F.translate(query, '-"', " '"), "*^~+()", "")
    return F.array_join(F.filter(F.split(F.trim(plain), r"\s+"), lambda t: t != ""), " AND ")


def sentences(text: Column) -> Column:
    """Sentences with their closing . ! ? ; or line break, trimmed, blank ones left out."""
    return tidy(pieces(text))


def pieces(text: Column) -> Column:
    """The text cut behind each . ! ? ; and line break."""
    return F.split(text, r"(?<=[.!?;\n])")


def tidy(cut: Column) -> Column:
    return F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def units(text: pd.Series) -> pd.Series:
    """Pieces of at most 1,200 bytes that make up the text."""
    return text.map(lambda t: None if t is None else units_of(t))


def contextual(title: Column, type_: Column, project: Column, topic: Column, content: Column) -> Column:
    part = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{name}="), x, F.lit(" ")))
    context = F.concat_ws("", F.lit("[Context: "), part("type", type_), part("project", project), part("topic", topic), F.lit("]"))
    return F.concat_ws("\n", title, context, content)


def specificity(token: Column) -> Column:
    """Weight of a query token: stop words least, codes and long words most."""
    return F.when(F.lower(token).isin(*COMMON_WORDS), 0.35).when(token.rlike(r"[0-9_]"), 2.2).when(F.octet_length(token) >= 8, 1.6).when(F.octet_length(token) <= 2, 0.6).otherwise(1.0)


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 100)


# Families of topic keys, by type and, in this order, by words in the text.
TYPE_FAMILIES = {
    "architecture": ["architecture", "design", "adr", "refactor"],
    "bug": ["bug", "bugfix", "fix", "incident", "hotfix"],
    "decision": ["decision"],
    "pattern": ["pattern", "convention", "guideline"],
    "config": ["config", "setup", "infra", "infrastructure", "ci"],
    "discovery": ["discovery", "investigation", "root_cause", "root-cause"],
    "learning": ["learning", "learn"],
    "session": ["session_summary"],
}
WORD_FAMILIES = {
    "bug": ["bug", "fix", "panic", "error", "crash", "regression", "incident", "hotfix"],
    "architecture": ["architecture", "design", "adr", "boundary", "hexagonal", "refactor"],
    "decision": ["decision", "tradeoff", "chose", "choose", "decide"],
    "pattern": ["pattern", "convention", "naming", "guideline"],
    "config": ["config", "setup", "environment", "env", "docker", "pipeline"],
    "discovery": ["discovery", "investigate", "investigation", "found", "root cause"],
    "learning": ["learned", "learning"],
}


def topic_family(type_: Column, title: Column, content: Column) -> Column:
    """The family of a topic key: by type, then by the first list that a word of the text is in, then the type itself."""
    t = F.trim(F.lower(F.coalesce(type_, F.lit(""))))
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    named = [F.when(t.isin(*words), family) for family, words in TYPE_FAMILIES.items()]
    spoken = [F.when(text.rlike("|".join(words)), family) for family, words in WORD_FAMILIES.items()]
    return F.coalesce(*named, *spoken, F.when(~t.isin("", "manual"), slug(t)), F.lit("topic"))


def suggested_topic(type_: Column, title: Column, content: Column) -> Column:
    """family/segment, the segment made of the title, else of the first eight words of the content."""
    family = topic_family(type_, title, content)
    opening = F.array_join(F.slice(F.filter(F.split(F.lower(F.coalesce(content, F.lit(""))), r"\s+"), lambda w: w != ""), 1, 8), " ")
    segment = F.coalesce(F.nullif(slug(F.coalesce(title, F.lit(""))), F.lit("")), F.nullif(slug(opening), F.lit("")), F.lit("general"))
    lead = F.concat(family, F.lit("-"))
    return F.concat_ws("/", family, F.when(F.startswith(segment, lead), F.substr(segment, F.char_length(lead) + 1)).otherwise(segment))


def normalised_topic(key: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(key)), r"\s+", "-"), 1, 120)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.floor(F.octet_length(text) / 4), F.lit(1)).cast("long")


def head_lines(text: Column, n: int = 20) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def first_line(text: Column, most: int = 80) -> Column:
    line = F.trim(F.substring_index(F.ltrim(text), "\n", 1))
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def normalised_query(query: Column) -> Column:
    """The query's words without punctuation, typing errors corrected."""
    table = F.create_map(*(F.lit(x) for pair in TYPOS.items() for x in pair))
    words = F.filter(F.split(F.regexp_replace(query, "[¿?¡!.,;:]", " "), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) == 0, F.trim(query)).otherwise(F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " "))


def expanded_query(query: Column) -> Column:
    """The words of the normalised query and their synonyms, each once, as alternatives."""
    more = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)))))
    words = F.filter(F.split(normalised_query(query), r"\s+"), lambda w: w != "")
    none = F.array().cast("array<string>")
    every = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(more, F.lower(w)), none))))
    once = F.aggregate(every, none, lambda done, w: F.when(F.exists(done, lambda x: F.lower(x) == F.lower(w)), done).otherwise(F.concat(done, F.array(w))))
    return F.array_join(F.when(F.size(once) <= F.size(words), words).otherwise(once), " or ")


# Patterns of the entity kinds with the groups that hold the value (0: all), in order; SQL words that name no table; endings of bare file names.
ENTITIES = {
    "url": (r"https?://[^\s\"'>)\]]+", (0,)),
    "file": (r"(?:^|[\s,(])([a-zA-Z0-9_/-]+\.[a-zA-Z]{1,10})(?:[\s,).;:]|$)", (1,)),
    "package": (r"(?:github\.com/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+|@[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+|from\s+['\"]([a-zA-Z0-9@/_.-]+)['\"])", (1, 0)),
    "symbol": (r"\b(?:func|type|class|function|def|const|var)\s+([A-Za-z_][A-Za-z0-9_]*)", (1,)),
    "sql_table": (r"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+`?([a-zA-Z_][a-zA-Z0-9_]*)`?", (1,)),
    "endpoint": (r"\b(?:GET|POST|PUT|DELETE|PATCH)\s+(/[a-zA-Z0-9/_\-{}:.]+)", (1,)),
    "env_var": (r"\$([A-Z_][A-Z0-9_]{2,})|\$\{([A-Z_][A-Z0-9_]{2,})\}", (1, 2)),
    "version": (r"\bv(\d+\.\d+(?:\.\d+)?)\b|\b(?:Node|Python|Go|Java|Ruby|Rust)\s+(\d+(?:\.\d+)+)", (1, 2)),
    "cli_flag": (r"\s(--[a-z][a-z0-9-]{2,}|-[a-zA-Z])\b", (1,)),
    "error": (r"\b(?:Error|panic|Exception|FATAL):\s*([^\n.]{10,80})", (1,)),
}
SQL_WORDS = ["SELECT", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "VALUES", "SET", "AND", "OR", "NOT", "NULL", "AS", "ON", "IN", "IS", "BY", "ASC", "DESC", "DISTINCT", "EXISTS", "BETWEEN", "LIKE", "CASE", "WHEN", "THEN", "ELSE", "END", "ALL"]
FILE_ENDINGS = ["go", "ts", "tsx", "js", "jsx", "py", "rs", "java", "kt", "rb", "yaml", "yml", "json", "toml", "xml", "sql", "sh", "md", "css", "html", "proto", "graphql", "vue", "svelte"]


def entities(text: Column) -> Column:
    """Distinct (kind, value) pairs of a text, as an array."""

    def of(kind: str, pattern: str, groups: tuple[int, ...]) -> Column:
        found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
        value = found[0] if len(found) == 1 else F.zip_with(found[0], found[1], lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))
        if kind == "url":
            value = F.transform(value, lambda v: F.rtrim(v, F.lit(".,;:!?)")))
        elif kind in ("cli_flag", "error"):
            value = F.transform(value, F.trim)
        elif kind == "file":
            value = F.filter(value, lambda v: v.contains("/") | F.regexp_extract(v, r"([^.]*)$", 1).isin(*FILE_ENDINGS))
        elif kind == "symbol":
            value = F.filter(value, lambda v: F.char_length(v) > 1)
        elif kind == "sql_table":
            value = F.filter(value, lambda v: ~F.upper(v).isin(*SQL_WORDS))
        return F.transform(F.filter(value, lambda v: v != ""), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.array_distinct(F.flatten(F.array(*(of(k, p, g) for k, (p, g) in ENTITIES.items()))))


@F.pandas_udf(T.StringType())
def canonical_entity(kind: pd.Series, value: pd.Series) -> pd.Series:
    plain = lambda c: unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" or c in "/:@.-_"
    keep = lambda v: "".join(filter(plain, unicodedata.normalize("NFKC", v.strip().lower())))
    return pd.Series([None if k is None or v is None else f"{k}:{keep(v)}" for k, v in zip(kind, value, strict=True)])


def chunks_of(text: str, size: int = 8000, overlap: int = 400) -> list[str]:
    """Windows of characters that end at a line break, full stop or semicolon where there is one in their second half."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            cut = max(text.rfind(x, at + size // 2, end) for x in "\n.;")
            end = cut + 1 if cut >= 0 else end
        out.append(text[at:end])
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def units_of(text: str, most: int = 1200) -> list[str]:
    """Byte-exact pieces of at most so many bytes, cut behind a sentence end, else a space in the back half, else hard."""
    raw, out = text.encode(), []
    while len(raw) > most:
        head = raw[:most]
        cut = max(head.rfind(x) for x in (b".", b"!", b"?", b";", b"\n")) + 1
        if cut <= 0:
            space = head.rfind(b" ", most // 2)
            cut = space + 1 if space >= 0 else most
        while cut > 1 and cut < len(raw) and raw[cut] & 0xC0 == 0x80:
            cut -= 1
        out.append(raw[:cut].decode())
        raw = raw[cut:]
    return [*out, raw.decode()] if raw else out


def chunks(size: int = 8000, overlap: int = 400):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else chunks_of(t, size, overlap))

    return cut


def preview_of(text: str, anchors: list[str], window: int = 1200) -> str:
    """The window that covers the most distinct anchor terms; it begins a third before the term it was found by."""
    if len(text) <= window:
        return text
    low = text.lower()
    places = sorted({m.start() for a in anchors if a for m in re.finditer(re.escape(a.lower()), low)})
    best, most = 0, -1
    for p in places:
        start = min(max(0, p - window // 3), len(text) - window)
        n = sum(a.lower() in low[start : start + window] for a in set(anchors) if a)
        if n > most:
            best, most = start, n
    return ("..." if best else "") + text[best : best + window] + ("..." if best + window < len(text) else "")


@F.pandas_udf(T.StringType())
def preview(text: pd.Series, anchors: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else preview_of(t, list(a) if a is not None else []) for t, a in zip(text, anchors, strict=True)])


def snippet_of(text: str, words: list[str], around: int = 8, open_: str = "[", close: str = "]") -> str:
    """Some words around the first hit, hits marked."""
    wanted, own = {w.lower() for w in words}, text.split()
    bare = [re.sub(r"\W+", "", w).lower() for w in own]
    at = next((i for i, w in enumerate(bare) if w in wanted), 0)
    low, high = max(0, at - around), min(len(own), at + around + 1)
    marked = [f"{open_}{w}{close}" if b in wanted else w for w, b in zip(own[low:high], bare[low:high], strict=True)]
    return ("... " if low else "") + " ".join(marked) + (" ..." if high < len(own) else "")


@F.pandas_udf(T.StringType())
def snippet(text: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else snippet_of(t, list(w) if w is not None else []) for t, w in zip(text, words, strict=True)])


PLACEHOLDER = "[REDACTED]"
_tag = re.compile(r"<(/?)private>", re.I | re.A)


def redacted(text: str, required: bool = False) -> tuple[str | None, str, int, str | None]:
    """Text without <private> passages, disposition (unchanged, redacted, rejected), their number, and the fault."""
    out, at, open_at, n = [], 0, None, 0
    for m in _tag.finditer(text):
        if not m[1]:
            if open_at is not None:
                return None, "rejected", 0, "nested private section"
            out.append(text[at : m.start()])
            open_at = m.end()
        else:
            if open_at is None:
                return None, "rejected", 0, "private section closed before it opens"
            out.append(PLACEHOLDER)
            n, at, open_at = n + 1, m.end(), None
    if open_at is not None:
        return None, "rejected", 0, "private section left open"
    done = "".join([*out, text[at:]])
    if re.search(r"</?private\b", done, re.I):
        return None, "rejected", 0, "malformed private tag"
    if required and not done.replace(PLACEHOLDER, "").strip():
        return None, "rejected", n, "nothing left outside private sections"
    return done, "redacted" if n else "unchanged", n, None


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("disposition", T.StringType()), T.StructField("sections", T.IntegerType()), T.StructField("error", T.StringType())]))
def redact(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, "unchanged", 0, None) if t is None else redacted(t) for t in text], columns=["text", "disposition", "sections", "error"])


# Headers of a learnings section.
LEARNINGS = r"(?im)^#{2,3}\s+(?:Aprendizajes(?:\s+Clave)?|Key\s+Learnings?|Learnings?):?\s*$"


def _plain(text: str) -> str:
    """Text without marks of bold, code and italics, spaces folded."""
    for mark in (r"\*\*([^*]+)\*\*", r"`([^`]+)`", r"\*([^*]+)\*"):
        text = re.sub(mark, r"\1", text)
    return " ".join(text.split())


def learnings_of(text: str) -> list[str]:
    """Items of the last learnings section that has any: numbered ones, else bullets, of 20 bytes and 4 words at least."""
    for head in reversed(list(re.finditer(LEARNINGS, text))):
        body = re.split(r"\n#{1,3} ", text[head.end() :])[0]
        for pattern in (r"(?m)^\s*\d+[.)]\s+(.+)", r"(?m)^\s*[-*]\s+(.+)"):
            items = [_plain(x) for x in re.findall(pattern, body)]
            items = [x for x in items if len(x.encode()) >= 20 and len(x.split()) >= 4]
            if items:
                return items
    return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def learnings(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [] if t is None else learnings_of(t))


# Patterns of memory drafts with type and confidence, in order.
DRAFTS = {
    "decision": (r"(?:decid(?:ed|e|ing)|decision|chose|selected|migrated to)\s+(.+?)(?:\.|\n|$)", 0.85),
    "bugfix": (r"(?:fixed|bug|error|resolved|patched|issue with)\s+(.+?)(?:\.|\n|$)", 0.85),
    "pattern": (r"(?:pattern|convention|architecture|standard|rule)\s*:\s*(.+?)(?:\.|\n|$)", 0.9),
}


def _draft_title(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.char_length(t) > 60, F.concat(F.substring(t, 1, 57), F.lit("..."))).otherwise(t)


def memory_drafts(text: Column) -> Column:
    """title, content, type and confidence of the lines that read like a decision, a bug fix or a pattern; else one note of the whole text."""

    def draft(title: Column, content: Column, kind: str, confidence: float) -> Column:
        return F.struct(_draft_title(title).alias("title"), content.alias("content"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))

    def of(line: Column) -> Column:
        hits = [(F.regexp_extract(line, f"(?is){p}", 1), k, c) for k, (p, c) in DRAFTS.items()]
        return F.coalesce(*(F.when(line.rlike(f"(?is){p}"), draft(h, line, k, c)) for (h, k, c), (p, _) in zip(hits, DRAFTS.values(), strict=True)))

    found = F.filter(F.transform(F.split(text, "\n"), lambda x: of(F.trim(x))), lambda s: s.isNotNull())
    return F.when(F.size(found) > 0, found).when(F.trim(text) != "", F.array(draft(text, text, "manual", 0.7))).otherwise(found)


def draft_edges(drafts: Column) -> Column:
    """Neighbouring drafts as related: from_title, to_title, relation, confidence."""
    pairs = F.zip_with(F.slice(drafts, 1, F.greatest(F.size(drafts) - 1, F.lit(0))), F.slice(drafts, 2, F.greatest(F.size(drafts) - 1, F.lit(0))), lambda a, b: F.struct(a["title"].alias("from_title"), b["title"].alias("to_title"), F.lit("relates_to").alias("relation"), F.lit(0.8).alias("confidence")))
    return pairs


# Words of the tiers, tested in this order, and the pattern of a lookup.
MULTI_HOP_WORDS = [
    "why", "por que", "por qué", "impact", "impacto", "depend", "dependencia", "connect", "conecta", "relat", "relacion", "relación", "caused by", "causa", "flow", "flujo", "workflow", "cycle", "ciclo",
    "trace", "trazabilidad", "blast radius", "blast_radius", "break", "rompe", "afecta", "afectado",
]
ARCHITECTURE_WORDS = ["architecture", "arquitectura", "overview", "resumen general", "structure", "estructura", "módulos", "modules", "high level", "alto nivel", "communities", "comunidades", "explain system"]
LOOKUP = r"^(?i)(func|struct|type|class|interface|const|var)\s+|^[a-zA-Z0-9_.-]+\.[a-zA-Z0-9]+$|^#[0-9]+$|^[a-zA-Z0-9_]{2,40}(\(\))?$"


def query_tier(query: Column) -> Column:
    """How much machinery a query asks for: words of graph questions first, then of overviews, then the looks of a lookup."""
    plain = F.trim(query)
    q = F.lower(plain)
    any_of = lambda words: q.rlike("|".join(words))
    lookup = plain.rlike(LOOKUP) | (~plain.contains(" ") & (F.octet_length(plain) < 40))
    return F.when(plain == "", "direct_factual").when(any_of(MULTI_HOP_WORDS), "multi_hop_graph").when(any_of(ARCHITECTURE_WORDS), "architectural_global").when(lookup, "direct_factual").otherwise("semantic_hybrid")


def speculative(query: Column) -> Column:
    return F.lower(query).rlike(r"\b(would|might|likely|probably)\b")


@lru_cache(1 << 18)
def stem_of(word: str) -> str:
    """Porter's suffix stripping, steps by table of (suffix, replacement, least measure)."""
    vowel = lambda w, i: w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))
    form = lambda w: "".join("v" if vowel(w, i) else "c" for i in range(len(w)))
    measure = lambda w: len(re.findall("v+c+", form(w)))
    if len(word) <= 2:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in form(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in form(w[:-3]):
        cut = w[:-3]
    short = lambda x: len(x) > 2 and form(x)[-3:] == "cvc" and x[-1] not in "wxy"
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and short(w):
            w += "e"
    if w.endswith("y") and "v" in form(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix, to in table:
            if w.endswith(suffix):
                w = w[: -len(suffix)] + to if measure(w[: -len(suffix)]) > 0 else w
                break
    for suffix in _STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or m == 1 and not short(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


# Suffix tables of the published algorithm.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


@F.arrow_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pa.Array) -> pa.Array:
    """Stems of each row's tokens; of a batch, each distinct word is looked at once."""
    words = tokens.flatten().dictionary_encode()
    stems = pa.array([w and stem_of(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(starts, stems, mask=tokens.is_null())
