"""Declarations, calls and imports of brace languages: a mask for strings and comments, and a stack of open blocks.

One pass a file, linear in its length. What symbols mean to each other is left to joins (operators/code.py)."""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_right

# Comments, strings and characters by family of languages; what a group named kept holds stays.
_SLASHES = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?"
_DOUBLE = r'"(?:[^"\\\n]|\\.)*"?'
_SINGLE = r"'(?:[^'\\\n]|\\.)*'?"
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'"
_PATTERN = r"(?P<kept>[=(,:!&|?;{}\[]\s*|\breturn\s+)/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\n\\\[])+/"
MASKS = {
    "go": f"{_SLASHES}|`[^`]*`?|{_DOUBLE}|{_CHAR}",
    "typescript": rf"{_SLASHES}|`(?:[^`\\]|\\.)*`?|{_DOUBLE}|{_SINGLE}|{_PATTERN}",
    "rust": rf'{_SLASHES}|\bb?r(?P<fence>#*)"[\s\S]*?"(?P=fence)|"(?:[^"\\]|\\[\s\S])*"?|{_CHAR}',
    "java": rf'{_SLASHES}|"""[\s\S]*?"""|{_DOUBLE}|{_CHAR}',
    "csharp": rf'{_SLASHES}|[$@]*@[$]*"(?:[^"]|"")*"?|{_DOUBLE}|{_CHAR}',
    "php": rf"{_SLASHES}|#(?!\[)[^\n]*|\"(?:[^\"\\]|\\[\s\S])*\"?|'(?:[^'\\]|\\[\s\S])*'?",
}
MASKS |= {"javascript": MASKS["typescript"], "kotlin": MASKS["java"], "swift": MASKS["java"], "cpp": MASKS["java"], "c": MASKS["java"]}
_masks = {k: re.compile(v) for k, v in MASKS.items()}

_WORDS_BEFORE = r"(?:(?:@\w+(?:\([^()\n]*\))?|\[\w+(?:\([^()\n]*\))?\]|public|private|protected|internal|fileprivate|static|final|abstract|sealed|partial|open|data|inner|value|annotation|companion|override|suspend|inline|operator|async|virtual|extern|readonly|synchronized|default|mutating|required|convenience|export|declare|unsafe|new|infix|tailrec|lateinit|external|const|strictfp|native|friend|constexpr|explicit)\s+)*"
_TYPE = r"[A-Za-z_][\w.:]*(?:\s*<[^;{}()]*>)?(?:\[\]|[?*&])*"
# Declarations by language as (pattern, kind); groups: kind, name, on (the type that a function belongs to), like (what a scope implements).
DECLARATIONS = {
    "go": [
        (r"^func\s*\(\s*(?:\w+\s+)?\*?\s*(?P<on>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s*\)\s*(?P<name>[A-Za-z_]\w*)", "method"),
        (r"^func\s+(?P<name>[A-Za-z_]\w*)", "function"),
        (r"^(?:type\s+|@\s*)(?P<name>[A-Za-z_]\w*)(?:\[[^\]\n]+\])?\s+(?:=\s*)?(?P<kind>struct\b|interface\b|)", "type"),
    ],
    "typescript": [
        (rf"(?m:^|(?<=[;{{}}]))\s*{_WORDS_BEFORE}(?P<kind>class|interface|enum|namespace)\s+(?P<name>[A-Za-z_$][\w$]*)", ""),
        (rf"(?m:^|(?<=[;{{}}]))\s*{_WORDS_BEFORE}type\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*=", "type"),
        (rf"(?m:^|(?<=[;{{}}=(]))\s*{_WORDS_BEFORE}function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)", "function"),
        (rf"(?m:^|(?<=[;{{}}]))\s*{_WORDS_BEFORE}(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?=>", "function"),
        (rf"(?m:^|(?<=[;{{}}]))[ \t]*{_WORDS_BEFORE}(?:(?:get|set)\s+)?\*?#?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^(){{}};]*>)?\([^(){{}}]*\)\s*(?::[^;{{}}=]+)?(?=\{{)", "member"),
    ],
    "rust": [
        (r"\bfn\s+(?P<name>[A-Za-z_]\w*)", "function"),
        (r"(?m:^|(?<=[;{}]))\s*(?:pub(?:\([^)]*\))?\s+)?(?P<kind>struct|enum|trait|mod|union)\s+(?P<name>[A-Za-z_]\w*)", ""),
        (r"(?m:^|(?<=[;{}]))\s*(?:unsafe\s+)?impl(?:\s*<[^{;]*?>)?\s+!?(?P<like>[\w:]+)(?:<[^{;]*?>)?\s+for\s+&?(?:mut\s+)?(?P<name>[\w:]+)", "scope"),
        (r"(?m:^|(?<=[;{}]))\s*impl(?:\s*<[^{;]*?>)?\s+(?P<name>[\w:]+)(?![\w:]*(?:<[^{;]*?>)?\s+for\b)", "scope"),
    ],
    "java": [
        (rf"(?m:^|(?<=[;{{}}]))\s*{_WORDS_BEFORE}(?P<kind>class|interface|enum|record|@interface)\s+(?P<name>[A-Za-z_]\w*)", ""),
        (rf"(?m:^|(?<=[;{{}}]))\s*{_WORDS_BEFORE}(?:<[^;{{}}()]*>\s*)?(?!(?:return|new|else|throw|case)\b)(?:{_TYPE}\s+)?(?P<name>[A-Za-z_]\w*)\s*\([^(){{}};]*\)\s*(?:throws\s+[\w.,\s]+)?(?=[{{;])", "member"),
    ],
    "kotlin": [
        (rf"(?m:^|(?<=[;{{}}]))\s*{_WORDS_BEFORE}(?:enum\s+)?(?P<kind>class|interface|object)\s+(?P<name>[A-Za-z_]\w*)", ""),
        (r"\bfun\s+(?:<[^>]*>\s*)?(?:(?P<on>[A-Za-z_]\w*)(?:<[^>]*>)?\??\.)?(?P<name>[A-Za-z_]\w*)\s*(?=\()", "function"),
    ],
    "swift": [
        (rf"(?m:^|(?<=[;{{}}]))\s*{_WORDS_BEFORE}(?P<kind>class|struct|enum|protocol|actor)\s+(?!func\b|var\b)(?P<name>[A-Za-z_]\w*)", ""),
        (rf"(?m:^|(?<=[;{{}}]))\s*{_WORDS_BEFORE}extension\s+(?P<name>[A-Za-z_][\w.]*)", "scope"),
        (r"\bfunc\s+(?P<name>[A-Za-z_]\w*)", "function"),
    ],
    "csharp": [
        (rf"(?m:^|(?<=[;{{}}]))\s*{_WORDS_BEFORE}(?P<kind>class|interface|struct|enum|record|namespace)\s+(?P<name>[A-Za-z_][\w.]*)", ""),
        (rf"(?m:^|(?<=[;{{}}]))\s*{_WORDS_BEFORE}(?!(?:return|new|else|throw|await|using)\b)(?:{_TYPE}\s+)?(?P<name>[A-Za-z_]\w*)\s*(?:<[^(){{}};]*>)?\([^(){{}};]*\)\s*(?=[{{;]|=>|where\b)", "member"),
    ],
    "cpp": [
        (r"(?m:^|(?<=[;{}]))\s*(?:template\s*<[^{};]*>\s*)?(?P<kind>class|struct|enum(?:\s+class)?|namespace|union)\s+(?P<name>[A-Za-z_]\w*)(?=[^;(){}]*\{)", ""),
        (r"(?m:^|(?<=[;{}]))[ \t]*(?!(?:return|else|new|delete|throw|case|goto)\b)(?:[A-Za-z_][\w:<>,*&~ \t]*[ \t*&])?(?:(?:\w+::)*(?P<on>[A-Za-z_]\w*)::)?(?P<name>~?[A-Za-z_]\w*)\s*\([^(){};]*\)\s*(?:const\b|noexcept\b|override\b|final\b|\s)*(?:->\s*[\w:<>]+\s*)?(?=\{)", "function"),
    ],
    "php": [
        (rf"(?m:^|(?<=[;{{}}]))\s*{_WORDS_BEFORE}(?P<kind>class|interface|trait|enum)\s+(?P<name>[A-Za-z_]\w*)", ""),
        (r"\bfunction\s+&?(?P<name>[A-Za-z_]\w*)", "function"),
    ],
}
DECLARATIONS |= {"javascript": DECLARATIONS["typescript"], "c": DECLARATIONS["cpp"]}
_declarations = {k: [(re.compile(p, re.M if k == "go" else 0), kind) for p, kind in v] for k, v in DECLARATIONS.items()}
# Names of kinds, words that no call begins with, and words at which a path through the code divides.
KINDS = {"mod": "module", "namespace": "module", "protocol": "interface", "trait": "interface", "object": "class", "actor": "class", "union": "struct", "@interface": "interface", "enum class": "enum"}
TYPES = {"class", "interface", "struct", "enum", "record", "module", "type", "scope"}
NO_CALLS = set("if for while switch catch return function fun new in when else do try throw await typeof sizeof and or not using lock foreach elseif echo isset unset super this self constructor assert yield import case".split())
OWN_WORDS = {"go": set("func go defer select range".split()), "rust": set("fn match loop unsafe where".split()), "swift": set("func guard init".split()), "php": set("print array list empty exit die include require".split())}
_branch = re.compile(r"\b(?:if|for|foreach|while|catch|case|when|match|elseif|guard)\b|&&|\|\||\bcase\b")
_call = re.compile(r"(?<![\w$.>:])((?:[A-Za-z_$][\w$]*\s*(?:\?\.|\.|::|->)\s*)*)(~?[A-Za-z_$][\w$]*)\s*(?:::\s*<[^()]*>)?!?\(")
_made = {
    "go": re.compile(r"(?<![\w.])(?P<name>(?:[A-Za-z_]\w*\.)?[A-Z]\w*)(?:\[[^\]\n]*\])?\{"),
    "rust": re.compile(r"(?<![\w:>])(?<!struct )(?<!enum )(?<!trait )(?<!impl )(?<!for )(?<!-> )(?P<name>[A-Z]\w*)\s*\{"),
}
_new = re.compile(r"\bnew\s+(?P<name>[A-Za-z_][\w.\\]*)")
_bases = re.compile(r"\b(extends|implements)\s+([^{;]*?)(?=\b(?:implements|extends|permits)\b|\{|;|$)")
_body = re.compile(r"[(){};\[\]]|=>|\n")


def masked(text: str, language: str) -> str:
    """The text with blanks in place of what strings and comments hold; lines and positions stay."""
    blank = lambda m: (m.groupdict().get("kept") or "") + re.sub(r"[^\n]", " ", m[0][len(m.groupdict().get("kept") or "") :])
    return _masks[language].sub(blank, text)


def blocks(code: str) -> dict[int, int]:
    """The end of each brace that opens a block; what is never closed ends with the text."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out | {x: len(code) for x in stack}


def body_of(code: str, at: int, ends: dict[int, int], language: str) -> tuple[int, int]:
    """Where the body behind a header begins and where the declaration ends; without a body, both are the header's end."""
    depth = 0
    for m in _body.finditer(code, at):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            if not depth:
                return m.start(), m.start()
            depth -= 1
        elif depth:
            continue
        elif m[0] == "{":
            end = ends[m.start()]
            after = code[end : end + 200].lstrip(" \t")
            if after.startswith("{") and language in ("go", "typescript", "javascript"):  # a literal type stood before
                start = code.index("{", end)
                return start, ends[start]
            return m.start(), end
        elif m[0] in ";}":
            return m.start(), m.start()
        elif m[0] == "=>" or (m[0] == "\n" and language == "kotlin" and "=" in code[at : m.start()]):
            rest = code[m.end() :].lstrip() if m[0] == "=>" else ""
            if rest.startswith("{"):
                continue
            stop = code.find("\n", m.end()) if m[0] == "=>" else m.start()
            return m.start() if m[0] == "=>" else at, len(code) if stop < 0 else stop
        elif m[0] == "\n" and language in ("go", "swift", "kotlin") and not re.match(r"\s*[{=:]", code[m.end() : m.end() + 80]):
            return m.start(), m.start()
    return len(code), len(code)


def go_groups(code: str) -> str:
    """type ( A struct {...} ): each name in the group, marked by @ in place of the blank before it."""
    out = list(code)
    for m in re.finditer(r"^type\s*\(", code, re.M):
        depth = 1
        for x in re.finditer(r"[(){}]|^[ \t]+(?=[A-Za-z_]\w*[ \t\[])", code[m.end() :], re.M):
            if x[0] in "({":
                depth += 1
            elif x[0] in ")}":
                depth -= 1
                if not depth:
                    break
            elif depth == 1:
                out[m.end() + x.start()] = "@"
    return "".join(out)


def bases(header: str, language: str) -> list[tuple[str, str]]:
    """What a type's header says that it extends or implements."""
    names = lambda x: [re.sub(r"[<(].*", "", n).strip().split(".")[-1].split("::")[-1] for n in re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", x)).split(",")]
    found = [(m[1], n) for m in _bases.finditer(header) for n in names(m[2])]
    if not found and language in ("kotlin", "swift", "csharp", "cpp"):
        while (bare := re.sub(r"\([^()]*\)|<[^<>]*>", "", header)) != header:
            header = bare
        _, _, listed = re.sub(r"\w*::", "", re.split(r"\bwhere\b", header)[0]).partition(":")
        listed = names(re.sub(r"\b(?:public|private|protected|virtual)\s+", "", listed))
        found = [("extends" if k == 0 and language != "swift" else "implements", n) for k, n in enumerate(listed)]
    return [(how, n) for how, n in found if re.fullmatch(r"[A-Za-z_$][\w$]*", n)]


def facts(path: str, language: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols (path, kind, name, parent, line, signature, doc, complexity) and relations (path, source, target, relation, line) of a file."""
    code = masked(text, language)
    if language == "go":
        code = go_groups(re.sub(r"\b(interface|struct)(\s*)\{(\s*)\}", lambda m: m[0].replace("{", " ").replace("}", " "), code))
    lines = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda at: bisect_right(lines, at)
    ends, seen, found, words = blocks(code), set(), [], NO_CALLS | OWN_WORDS.get(language, set())
    for pattern, kind in _declarations[language]:
        for m in pattern.finditer(code):
            name = m["name"].split("::")[-1]
            if name in words and (kind == "member" or language in ("cpp", "c")) or m.start("name") in seen:
                continue
            seen.add(m.start("name"))
            groups = m.groupdict()
            own = (groups.get("kind") or "").strip() or kind
            own = KINDS.get(" ".join(own.split()), own)
            start, end = body_of(code, m.end() - 2 * m[0].endswith("=>"), ends, language)
            found.append([m.start("name"), start, end, own, name, groups.get("on"), groups.get("like")])
    found.sort()
    base = path.rsplit("/", 1)[-1]
    symbols, relations = [(path, "module", base, None, 1, base, "", 1)], []
    spans, stack = [], []
    for at, start, end, kind, name, on, like in found:
        while stack and stack[-1][1] <= at:
            stack.pop()
        outer = stack[-1] if stack else None
        inside = outer is not None and outer[2] in TYPES
        if kind == "member" and not (inside or start < end and language in ("csharp",)):
            continue
        parent = on or (outer[3] if inside and outer[2] != "module" else None)
        if kind in ("function", "member", "method"):
            kind = "method" if parent else "function"
        stack.append((start, end, kind, name))
        head = code[at:start]
        if kind == "scope":
            if like:
                relations.append((path, name, like.split("::")[-1], "implements", line(at)))
        else:
            flow = list(_branch.finditer(code, start, end)) if kind in ("function", "method") else ()
            complexity = 1 + sum(_cases(code, m, language) for m in flow)
            first = max(code.rfind(x, 0, at) for x in "\n;{}") + 1
            signature = " ".join(text[first:start].split())[:200]
            symbols.append((path, kind, name, parent, line(at), signature, "", complexity))
            relations.append((path, base, name, "defines", line(at)))
            if parent:
                relations.append((path, parent, name, "contains", line(at)))
                if on and language == "go":
                    relations.append((path, name, on, "implements", line(at)))
        if kind in TYPES:
            relations += [(path, name, n, how, line(at)) for how, n in bases(head, language) if n != name]
        if kind in ("function", "method"):
            spans.append((at, start, end, name))
    return symbols, relations + _uses(path, language, code, spans, seen, line)


def _cases(code: str, m: re.Match, language: str) -> int:
    """How many ways a branching word adds: one for each value of a case of Go."""
    if m[0] == "case" and language == "go":
        depth = 0
        n = 1
        for x in re.finditer(r"[()\[\]{},:\n]", code[m.end() : m.end() + 2000]):
            if x[0] in "([{":
                depth += 1
            elif x[0] in ")]}":
                depth -= 1
            elif not depth and x[0] == "," and code[m.end() + x.end() :].lstrip()[:1] != "":
                n += 1
            elif not depth and x[0] == ":":
                return 1 if "<-" in code[m.end() : m.end() + x.start()] else n
        return n
    return 1


def _uses(path: str, language: str, code: str, spans: list[tuple], named: set[int], line) -> list[tuple]:
    """Calls and instantiations, each from the innermost function that holds it."""
    made, words = _made.get(language, _new), NO_CALLS | OWN_WORDS.get(language, set())
    uses = [(m.start("name"), m["name"].replace("\\", ".").split(".")[-1], "instantiates") for m in made.finditer(code)]
    created = {at for at, _, _ in uses}
    for m in _call.finditer(code):
        before = re.sub(r"\s+", "", m[1])
        if m.start(2) in named or m[2] in words or re.split(r"\W", before)[0] in words - {"this", "self", "super"} or m.start(1) in created or m.start(2) in created or (language == "go" and before.count(".") > 1):
            continue
        uses.append((m.start(1), before.replace("::", ".").replace("->", ".").replace("?.", ".") + m[2], "calls"))
    out, stack, k = [], [], 0
    for at, name, how in sorted(uses):
        while k < len(spans) and spans[k][1] <= at:
            stack.append(spans[k])
            k += 1
        while stack and stack[-1][2] <= at:
            stack.pop()
        if stack:
            out.append((path, stack[-1][3], name, how, line(at)))
    return list(dict.fromkeys(out))


# Imports by language; groups: path, and names or alias.
IMPORTS = {
    "typescript": r"""(?m)\bimport\s+(?:type\s+)?(?P<names>[\w$*{}\s,]+?)\s+from\s*['"](?P<path>[^'"\n]+)|\bexport\s+(?P<again>\*|\{[^}]*\})\s*from\s*['"](?P<path2>[^'"\n]+)|\bimport\s*['"](?P<path3>[^'"\n]+)|(?:(?:const|let|var)\s+(?P<names4>[\w${},\s:]+?)\s*=\s*)?require\(\s*['"](?P<path4>[^'"\n]+)""",
    "rust": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<path>[^;]+);", "java": r"(?m)^\s*import\s+(?:static\s+)?(?P<path>[\w.]+(?:\.\*)?)\s*;", "kotlin": r"(?m)^\s*import\s+(?P<path>[\w.]+(?:\.\*)?)(?:\s+as\s+(?P<alias>\w+))?",
    "csharp": r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<path>[\w.]+)\s*;", "cpp": r'(?m)^\s*#\s*include\s*[<"](?P<path>[^>"\n]+)', "php": r"(?m)^\s*use\s+(?:function\s+|const\s+)?(?P<path>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;",
    "swift": r"(?m)^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|enum|protocol|func)\s+)?(?P<path>[\w.]+)", "ruby": r"""(?m)^\s*require(?P<near>_relative)?\s+['"](?P<path>[^'"\n]+)""", "fsharp": r"(?m)^\s*open\s+(?P<path>[\w.]+)", "vbnet": r"(?mi)^\s*imports\s+(?P<path>[\w.]+)",
    "python": r"(?m)^\s*from\s+(?P<path>[\w.]+)\s+import\s+(?P<names>\([^)]*\)|[^\n#;]+)|^\s*import\s+(?P<path2>[\w.]+)(?:\s+as\s+(?P<alias>\w+))?",
}
IMPORTS |= {"javascript": IMPORTS["typescript"], "c": IMPORTS["cpp"]}
_imports = {k: re.compile(v) for k, v in IMPORTS.items()}
_go_import = re.compile(r'^import\s*(?:(?P<alias>[\w.]+)\s*)?"(?P<path>[^"\n]+)"|^import\s*\((?P<many>[^)]*)\)', re.M)
_go_line = re.compile(r'^\s*(?:(?P<alias>[\w.]+)\s+)?"(?P<path>[^"\n]+)"', re.M)


def _named(listed: str, split: str = ",") -> list[tuple[str, str]]:
    """(imported, local) of a list such as `a, b as c`."""
    out = []
    for part in re.sub(r"[{}()\\\n]", " ", listed).split(split):
        words = part.replace(":", " as ").split()
        if words and words[0] == "type" and len(words) > 1:
            words = words[1:]
        if words:
            out.append((words[0], words[2] if len(words) > 2 and words[1] == "as" else words[-1] if words[0] != "*" else words[0]))
    return out


def _rust_uses(path: str) -> list[tuple[str, str, str]]:
    """(path, imported, local) of each name in a use tree."""
    path = path.strip()
    if "{" in path:
        before, inner = path.split("{", 1)
        parts, depth, at = [], 0, 0
        inner = inner.rsplit("}", 1)[0]
        for k, c in enumerate(inner):
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts, at = [*parts, inner[at:k]], k + 1
        return [x for p in [*parts, inner[at:]] if p.strip() for x in _rust_uses(before + p.strip())]
    name, _, alias = path.partition(" as ")
    head, _, last = name.strip().rpartition("::")
    if last == "self":
        head, last = head.rpartition("::")[0], head.rpartition("::")[2]
    return [(head, last, alias.strip() or last)]


def module_of(path: str, source: str, language: str) -> tuple[str, bool]:
    """What an import names as a path without ending, and whether it is meant from the file's own place."""
    folder = posixpath.dirname(path)
    if language == "python":
        up = len(source) - len(source.lstrip("."))
        rest = source.lstrip(".").replace(".", "/")
        return (posixpath.normpath(posixpath.join(folder, *[".."] * (up - 1), rest)), True) if up else (rest, False)
    if language == "rust":
        for word, own in (("self", posixpath.splitext(path)[0]), ("super", folder)):
            if source == word or source.startswith(word + "/"):
                return posixpath.normpath(posixpath.join(own, source[len(word) + 1 :])), True
        return ("" if source == "crate" else source.removeprefix("crate/")), False
    if source.startswith("."):
        source, near = posixpath.normpath(posixpath.join(folder, source)), True
    else:
        near = False
    return re.sub(r"\.(?:[jt]sx?|mjs|cjs|d\.ts|h|hpp|hh|hxx|rb|php)$", "", source), near


def imports(path: str, language: str, text: str) -> list[tuple]:
    """(path, module, near, imported name or *, local name, line, path as written) of a file."""
    return [(path, *module_of(path, source, language), name, local, at, source) for _, source, name, local, at in _imports_of(path, language, text)]


def _imports_of(path: str, language: str, text: str) -> list[tuple]:
    line = lambda at: text.count("\n", 0, at) + 1
    if language == "go":
        found = []
        for m in _go_import.finditer(text):
            found += [(x, m.start("many") + x.start("path")) for x in _go_line.finditer(m["many"])] if m["many"] is not None else [(m, m.start("path"))]
        return [(path, x["path"], "*", "*" if x["alias"] == "." else x["alias"] or x["path"].rsplit("/", 1)[-1], line(at)) for x, at in found]
    out = []
    for m in _imports[language].finditer(text) if language in _imports else ():
        g = m.groupdict()
        source, at = next(v for k, v in g.items() if k.startswith("path") and v), line(m.start() + len(m[0]) - len(m[0].lstrip()))
        if language == "rust":
            out += [(path, p.replace("::", "/"), name, local, at) for p, name, local in _rust_uses(source)]
        elif language in ("typescript", "javascript"):
            names = g["names"] or g["names4"] or g["again"] or "*"
            bare = re.sub(r"\{[^}]*\}", "", names)
            inner = re.search(r"\{([^}]*)\}", names)
            each = [("*" if w[0] == "*" or g["path4"] else "default", w[1]) for w in _named(bare)] + (_named(inner[1]) if inner else [])
            out += [(path, source, name, local, at) for name, local in each or [("*", "*")]]
        elif language == "python":
            if g["names"]:
                out += [(path, source, name, local, at) for name, local in _named(g["names"])]
            else:
                out.append((path, source, "*", g["alias"] or source.split(".")[-1], at))
        elif language in ("java", "kotlin", "php"):
            head, _, last = source.replace("\\", ".").rpartition(".")
            out.append((path, head.replace(".", "/"), last, g.get("alias") or last, at))
        else:
            near = "./" if g.get("near") else ""
            whole = source if language in ("cpp", "c", "ruby") else source.replace(".", "/")
            out.append((path, near + whole, "*", g.get("alias") or "*", at))
    return out
