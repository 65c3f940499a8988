"""Natural cut lines of sources and Markdown: where top-level definitions and headings start. A helper per text."""

from __future__ import annotations

import re
from bisect import bisect_right

STRINGS_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?"
SKIP = {
    "python": re.compile(r"#[^\n]*|(?i:[rbfu]{0,2})(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)", re.S),
    "js": re.compile(STRINGS_C + r"|" + QUOTED + r"|'(?:\\.|[^'\\\n])*'?|`(?:\\.|\$\{[^{}`]*\}|[^`\\])*(?:`|\Z)|(?<=[=(,:;!&|?{}\[\n])\s*/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*", re.S),
    "go": re.compile(STRINGS_C + r"|" + QUOTED + r"|`[^`]*(?:`|\Z)|'(?:\\.|[^'\\\n])+'", re.S),
    "rust": re.compile(r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*.*?\*/)*(?:\*/|\Z)|b?r(#*)\".*?(?:\"\1|\Z)|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|b?'(?:\\[^\n]{1,8}?|[^'\\\n])'", re.S),
    "java": re.compile(STRINGS_C + r"|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|" + QUOTED + r"|'(?:\\.|[^'\\\n])+'", re.S),
}
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "js", ".ts": "js", ".mts": "js", ".cts": "js", ".tsx": "js",
    ".go": "go", ".rs": "rust", ".java": "java", ".md": "markdown", ".markdown": "markdown",
}
STARTS = {
    "python": re.compile(r"(?:async\s+)?def\s|class\s"),
    "js": re.compile(
        r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\b|class\b|interface\s|(?:const\s+)?enum\s|namespace\s|type\s+[\w$]+(?:<[^=]*>)?\s*=)"
        r"|(?:export\s+)?(?:const|let|var)\s+[\w$]+\s*(?::[^=]+(?:=>[^=]+)?)?=\s*(?:async\s+)?(?:function\b|class\b|(?:<[^>]*>\s*)?\([^{]*(?:\{[^{}]*\}[^{]*)*=>|(?:<[^>]*>\s*)?\([^)]*$|[\w$]+\s*=>)"
        r"|(?:module\.)?exports(?:\.[\w$]+)?\s*=\s*(?:async\s+)?(?:function\b|class\b|\([^{]*=>)|export\s+default\s+(?:async\s+)?\([^{]*=>"),
    "go": re.compile(r"func\b|type\s+\w|type\s*\("),
    "rust": re.compile(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?(?:(?:async|const|unsafe|extern(?:\s+\"\s*\")?|extern\s+[^\w{]*)\s+)*(?:fn|struct|enum|impl|trait|type|mod|union)\b|macro_rules!"),
    "java": re.compile(r"(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+\w"),
}
ABOVE = {"python": ("@",), "js": ("@",), "go": (), "rust": ("#[", "#!["), "java": ("@",)}
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
ATX = re.compile(r" {0,3}#{1,6}(?:\s|$)")
UNDERLINE = re.compile(r" {0,3}(?:=+|-+)\s*$")
NO_TEXT = re.compile(r"\s*$| {4,}|\t| {0,3}(?:#{1,6}\s|>|[-*+]\s|\d{1,9}[.)]\s|(?:[-*_]\s*){3,}$|\||<)")


def markdown_lines(lines: list[str]) -> list[int]:
    """Numbers (from 0) of heading lines outside fenced code."""
    out, fence = [], ""
    for i, line in enumerate(lines):
        line = line.rstrip("\r")
        m = FENCE.match(line)
        if fence:
            if m and m[1].startswith(fence) and not m[2].strip():
                fence = ""
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
        elif ATX.match(line):
            out.append(i)
        elif i and UNDERLINE.match(line) and not NO_TEXT.match(lines[i - 1].rstrip("\r")) and (not out or out[-1] != i - 1):
            top = i - 1
            while top and not NO_TEXT.match(lines[top - 1].rstrip("\r")) and not UNDERLINE.match(lines[top - 1].rstrip("\r")) and not FENCE.match(lines[top - 1]):
                top -= 1
            out.append(top)
    return out


def definition_lines(text: str, language: str) -> list[int]:
    """Numbers (from 0) of the lines at which top-level definitions of more than one line start.

    Comments, decorators and attributes directly above belong to a definition. Strings and comments are blanked first; a
    line is at top level if no bracket is open and it isn't indented.
    """
    starts = [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())
    notes: set[int] = set()
    code, at = [], 0
    for m in SKIP[language].finditer(text):
        code.append(text[at:m.start()])
        part = m[0]
        at = m.end()
        if part[:1] == "#" and language == "python" or part[:2] in ("//", "/*"):
            first, last = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1) - 1
            if not text[starts[first]:m.start()].strip() and not text[m.end():starts[last + 1] if last + 1 < len(starts) else len(text)].strip():
                notes.update(range(first, last + 1))
            code.append(re.sub(r"[^\n]", " ", part))
        else:
            code.append(re.sub(r"[^\n]", "\x01", part))
    code.append(text[at:])
    lines = "".join(code).split("\n")
    out: list[int] = []
    depth = 0
    start = STARTS[language]
    hooks = ABOVE[language]
    hooked = -1
    for i, line in enumerate(lines):
        before = depth
        for c in re.findall(r"[(){}\[\]]", line):
            depth = depth + 1 if c in "({[" else max(0, depth - 1)
        if not line or line[0] in " \t\r}\x01)":
            continue
        if depth and before and language != "python" and start.match(line) and re.match(r"\S.*\{\s*$", line) and lines[i - 1].strip("\r ") == "":
            before, depth = 0, line.count("{") - line.count("}") + line.count("(") - line.count(")")
        if before:
            continue
        if hooks and line.startswith(hooks):
            hooked = i
            continue
        if not start.match(line):
            continue
        if language == "python":
            body = i + 1
            while body < len(lines) and not lines[body].strip("\r "):
                body += 1
            long = depth > 0 or (line.rstrip().endswith(":") and body < len(lines) and lines[body][:1] in " \t\x01")
        else:
            follow = lines[i + 1].lstrip() if i + 1 < len(lines) else ""
            long = depth > 0 or follow.startswith(("{", "where", "|", ".", "extends ", "implements ", "permits ", "throws ")) or line.rstrip("\r ").endswith(("=", "|", ","))
        if not long:
            continue
        top = i
        while top:
            if top - 1 in notes or hooks and lines[top - 1].startswith(hooks):
                top -= 1
            elif hooked >= 0 and (begin := _hook_start(lines, top - 1, hooks)) >= 0:
                top = begin
            else:
                break
        out.append(top)
    return out


def _hook_start(lines: list[str], i: int, hooks: tuple[str, ...]) -> int:
    """The first line of the decorator or attribute of several lines that line ``i`` ends; -1 if it ends none."""
    if not lines[i].strip() or lines[i][0] not in ")]} \t":
        return -1
    depth = 0
    for j in range(i, -1, -1):
        if not lines[j].strip():
            return -1
        depth += sum(1 if c in ")]}" else -1 for c in re.findall(r"[(){}\[\]]", lines[j]))
        if lines[j].startswith(hooks):
            return j if depth == 0 else -1
        if depth <= 0 and lines[j][0] not in " \t":
            return -1
    return -1


def natural_lines(text: str, path: str) -> list[int]:
    """Numbers (from 1, within the text) of natural cut lines, without the first line."""
    language = LANGUAGES.get("." + path.lower().rpartition(".")[2])
    if language is None:
        return []
    found = markdown_lines(text.split("\n")) if language == "markdown" else definition_lines(text, language)
    return sorted({i + 1 for i in found if i > 0})
