"""Problem 1: credentials in source text, found by entropy and context, and masked in place.

Candidates are all quoted strings and long tokens, and values of settings. A candidate is a credential if its Shannon entropy,
against what a string of its length and alphabet can reach, is high enough for the place where it stands: next to a name that
says it is secret little is asked, elsewhere it must be as random as a key of its length or carry an issuer's prefix. Hashes, identifiers,
placeholders, references and encrypted values are left out.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

# Names of settings whose value is secret; nouns that end such a name.
SECRET_NAMES = [
    r"pass(?:word|wd|phrase|code)?", "pwd", "pw", "secret", r"credentials?", r"api[_.-]?key", r"secret[_.-]?key", r"private[_.-]?key",
    r"master[_.-]?key", r"encryption[_.-]?key", r"signing[_.-]?key", r"access[_.-]?key", r"account[_.-]?key", r"auth[_.-]?key",
    r"access[_.-]?token", r"auth[_.-]?token", r"refresh[_.-]?token", r"private[_.-]?token", r"session[_.-]?token", r"bot[_.-]?token",
    r"bearer[_.-]?token", r"api[_.-]?token", r"deploy[_.-]?token", r"hmac[_.-]?salt", r"bot[_.-]?auth", r"webhook[_.-]?secret", r"client[_.-]?secret",
]
# What issuers put before their keys.
PREFIXED = (
    r"AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{18,}|xox[abprs]-[\w-]{12,}"
    r"|sk-[A-Za-z0-9_-]{20,}|[a-z]{2,4}_live_[A-Za-z0-9]{16,}|AIza[\w-]{35}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}"
)
# Files of programming languages, where a setting's value stands in quotes; in all others it needs none.
QUOTING = (".py", ".pyi", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".mts", ".cts", ".tsx", ".go", ".rs", ".java", ".kt", ".scala", ".c", ".h", ".cc", ".cpp", ".hpp",
           ".cs", ".rb", ".php", ".swift", ".css", ".scss", ".json", ".sql")

NAME = re.compile(r"(?i)(?:^|[_.\-\s]|^PG|^DB|(?<=[a-z0-9])(?=[A-Z]))(?:" + "|".join(SECRET_NAMES) + r")(?:[_.-]?\d+)?$")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
# Letters that a line with a credential holds, found in one pass over a text; the first need a value after them.
WORDS = ["pass", "Pass", "PASS", "pwd", "Pwd", "PWD", "ecret", "ECRET", "key", "Key", "KEY", "oken", "OKEN", "salt", "Salt", "SALT",
         "auth", "Auth", "AUTH", "redential", "REDENTIAL", "login", "Login", "LOGIN", " pw", "_pw", "_PW"]
MARKS = ["PRIVATE KEY", "Bearer ", "Basic ", "AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "xoxa-", "xoxb-", "xoxp-",
         "xoxr-", "xoxs-", "sk-", "_live_", "AIza", "eyJ", "://",
         " -u ", "--user ", "uthenticate(", "ession(", "onnect(", "ign_in(", "ignIn(", "og_in("]
WORD_TAIL = re.compile(
    r"(?:word|wd|phrase|code|enc|s|S|WORD|WD|PHRASE)?(?:[_.-]?\d+)?(?:[ \t]*(?:is|was|:|=|->)?[ \t]+[\"'`]?(?=[^\s\"'`]{8})(?P<note>[^\s\"'`]*\d[^\s\"'`]*)"
    r"|[\"']?[ \t]*(?::[^=\n\"'`;{]*+=|:=|=>|=|:)[ \t]*(?P<q>[\"'`]|concat!\()?[^\s\"'`]{0,4}|\([\"'])")  # fmt: skip
URL_TAIL = re.compile(r"[^\s/\"'@:]*+:[^\s/\"'@]+@")
_spotter: list = []


def spotter():
    """The automaton of all words and marks, built once in each Python worker."""
    if not _spotter:
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in WORDS:
            a.add_word(w, 1)
        for w in MARKS:
            a.add_word(w, 2 if w == "://" else 0)
        a.make_automaton()
        _spotter.append(a)
    return _spotter[0]


QUOTED = re.compile(r'"((?:\\.|[^"\\])*)"|\'((?:\\.|[^\'\\])*)\'|`([^`]*)`')
URL = re.compile(r"(?<![\w+.\-])(?:(?![a-zA-Z])[\w+.\-])*+([a-zA-Z][\w+.\-]*+)://([^\s/\"'@:]*):([^\s/\"'@]+)@[\w.\-\[]")
HEADER = re.compile(r"\b(Bearer|Basic)\s+([A-Za-z0-9._~+/=\-]{8,})")
QUERY = re.compile(r"[?&](?:access_token|api_?key|auth_?token|token|secret|sig|signature|password|key)=([^\s&\"'`#]+)", re.I)
CALL = re.compile(r"""(?i)(?:login|log_in|sign_?in|authenticate|connect|session|auth|password|credentials?)\(\s*["'][^"']*["']\s*,\s*["']([^"'\s]+)["']""")
NOTE = re.compile(r"""(?i)(?:\blogin|\bpassword|\bpasswd|\bpwd|\bpass|\bpw|\bkey|\btoken|\bsecret|\bcredentials?)\s*(?:is|was|:|=|->)?\s+["'`]?([^\s"'`]{6,})""")
PLACEHOLDER = re.compile(
    r"(?i)^$|change.?me|^your\b|^your[_-]|<[^>]*>|^x{3,}|x{6,}|\*{3,}|\.{3,}|redacted|^todo|^none$|^null$|^nil$|^true$|^false$|^undefined$|see[-_ ]vault|set[-_]?me|replace[-_]?me"
    r"|example|placeholder|dummy|^fixme|^secret$|^password$|^token$|^\?+$|^-+$|insert[-_ ]|^n/?a$|^empty$|^default$|^test$|^foo|^bar$")  # fmt: skip
REFERENCE = re.compile(r"(?i)\$\{|\$\(|^\$\w|\{\{|^\{\w|%\(?\w+\)?[s%]|^%\w+%|^(?:vault|aws|gcp|azure|ref\+\w+|op|ssm|env|file|secret|keyvault|kms|sops)[:/]|^ENC[\[(]|^AgB|^\$ANSIBLE|^!|^\*\w+$|^&\w+$|environ|process\.env|getenv|secretsmanager|arn:aws")
IDENTIFIER = re.compile(r"^[A-Za-z]+(?:[-_/. ][A-Za-z0-9]{1,}k?)*$|^[A-Za-z]+$")
USER = re.compile(r"""\s(?:-u|--user)[ =]+["']?[^\s:"']+:([^\s"']+)""")
BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
HEX = re.compile(r"^[0-9a-fA-F]+$")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
# What stands before hashes and embedded data; the length from which a string is data.
STAMPED = re.compile(r"(?i)^(?:sha\d+|md5|h1|v\d+|blob|etag|rev|id)[-:=_]")
DATA = re.compile(r"(?i)(?:base64,|sha\d+[-:=]|integrity\W{1,4}|checksum\W{1,4}|h1:|ssh-(?:rsa|ed25519|dss) |ENC[\[(]|\$\{\w*|\{\{ *)$")
# A row of embedded data: nothing but one long string.
ROW = re.compile(r"""[\s"'`#*/+(\[]*[A-Za-z0-9+/=_-]{12,}[\s"'`,;+)\]\\n]*""")
CAMELS = re.compile(r"^[a-z]*(?:[A-Z][a-z]{2,}){2,}\d*$")
# A word joined to a long hexadecimal number, as issuers mark their keys; the words of hashes and ids aren't meant.
TAGGED = re.compile(r"^(?P<tag>[a-z]{0,7}[g-z])(?P<body>[0-9a-f]{32,})$")
HASH_TAG = re.compile(r"^(?:rev|hash|build|commit|sha|git|obj|tree|etag|crc|sum|uuid|guid|img|layer|digest|chunk|asset)$")
COMMENT = re.compile(r"(?:^|\s)(?:#|//|/\*|\*|--|;|<!--)\s")
WORDLIKE = re.compile(r"[A-Za-z]*\d*")
#: Length up to which a string may be a key; a longer one without an issuer's prefix, key block marks or a secret name is data.
LONGEST = 512
# Quoted strings without blanks, and long tokens outside of quotes; long tokens within quoted addresses.
STRING = re.compile(r"""(?P<q>["'`])(?P<v>[^\s"'`\\]{12,})(?P=q)|(?<![\w+/.~-])(?P<t>[A-Za-z0-9_+/.~-]{20,}={0,2})(?![\w+/.~-])""")
INNER = re.compile(r"(?<=[/=?&:#,;|])[A-Za-z0-9_~-]{16,}(?=$|[/&:#,;|])")
KEYED = re.compile(r"(?i)(?:token|key|secret|auth|salt|pat|credentials?|pass\w{0,6}|pwd|sig|signature)[\"'\])]*\s*(?::=|=>|=|:|\()\s*[&\w]{0,8}[\"'`]?$")
UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
BODY = re.compile(r"^[\s#/*;\"'+,\\n]*[A-Za-z0-9+/=]{4,}[\s\"'+,\\n`;)]*$|^\s*(?:Proc-Type|DEK-Info):")


def entropy(s: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def randomness(s: str) -> float:
    """Entropy as a share of what a string of this length and alphabet reaches at most."""
    size = 16 if HEX.match(s) else 36 if s.isalnum() and (s.islower() or s.isupper()) else 62 if s.isalnum() else 72
    return entropy(s) / math.log2(max(2, min(size, len(s))))


@lru_cache(maxsize=100_000)
def expected_entropy(n: int, size: int) -> float:
    """Mean entropy of ``n`` characters drawn at random from an alphabet of ``size``."""
    p, total = 1 / size, 0.0
    for k in range(1, n + 1):
        chance = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        total -= size * chance * (k / n) * math.log2(k / n)
        if k > n * p and chance < 1e-12:
            break
    return total


def looks_random(value: str, named: bool = False) -> bool:
    """Whether any string, wherever it stands, is as random as a key of its length and alphabet.

    The bound is the entropy that random strings of the same length and alphabet have, less a margin; beside a name that ends like a
    secret's the margin is wider and shorter values count. Hashes, ids, digits, embedded data and words are out.
    """
    if not (12 if named else 20) <= len(value) <= LONGEST or excluded(value) or UUID.match(value) or HEX.match(re.sub(r"[-:.]", "", value)) or STAMPED.search(value) or CAMELS.match(value):
        return False
    if (m := TAGGED.match(value)) and not HASH_TAG.match(m["tag"]):
        return entropy(m["body"]) >= expected_entropy(len(m["body"]), 16) - 0.35
    runs = re.findall(r"[A-Za-z0-9]+", value)
    if len(runs) > 1 and all(WORDLIKE.fullmatch(r) for r in runs):
        return False
    plain = "".join(runs)
    if len(plain) < 0.7 * len(value) or not LETTER.search(plain):
        return False
    cased = plain.lower() != plain and plain.upper() != plain
    pairs = sum(len(r) - 1 for r in runs)
    kinds = [["d" if c.isdigit() else "l" if c.islower() else "u" for c in r] for r in runs]
    changes = sum(a != b for r in kinds for a, b in zip(r, r[1:]))
    if not DIGIT.search(plain) and (not named or len(plain) < 20 or not cased or changes < 0.38 * pairs):
        return False  # letters alone are words, unless their case keeps changing beside a secret's name
    if max(map(len, runs)) < 8 or changes < pairs * ((0.3 if named else 0.4) if cased else (0.15 if named else 0.22)):
        return False  # words joined by signs or capitals change between letters, capitals and digits less often
    size = 62 if cased else 36
    return entropy(plain) >= expected_entropy(len(plain), size) - (0.6 if named else 0.35)


def excluded(value: str) -> bool:
    """Placeholders, masked or empty values, references and encrypted values."""
    return bool(PLACEHOLDER.search(value) or REFERENCE.search(value)) or len(set(value)) < 4


def named_secret(value: str) -> bool:
    """Whether the value of a secret setting is usable: little entropy is asked, but identifiers and prose are out."""
    if len(value) < 6 or excluded(value) or any(c.isspace() for c in value):
        return False
    if re.fullmatch(PREFIXED, value):
        return True
    if IDENTIFIER.match(value) and not re.search(r"\d{3,}$|[A-Za-z]\d[A-Za-z]", value):
        return randomness(value) > 0.86 and len(value) >= 16 and sum(a.islower() != b.islower() for a, b in zip(value, value[1:])) > len(value) / 4
    return entropy(value) >= 2.3 and bool(re.search(r"\d|[^\w]", value)) and not re.search(r"[()\[\]{}<>]|\.\w+\.\w+\(", value)


def note_secret(value: str) -> bool:
    """A token after a word like login in running text must mix letters with digits, and with case or signs."""
    v = value.rstrip(".,;:)")
    if len(v) < 8 or excluded(v) or UUID.match(v) or re.search(r"[()\[\]{}<>\"]|^[\w./-]+\.(?:py|js|ts|go|rs|java|md|json)$", v):
        return False
    return bool(re.fullmatch(PREFIXED, v)) or (bool(re.search(r"[A-Za-z]", v) and re.search(r"\d", v)) and bool(re.search(r"[!#$%&*+?@^~]", v) or (randomness(v) > 0.85 and len(v) >= 16 and not HEX.match(v))))


def parts_from(line: str, at: int, macro: bool) -> list[tuple[str, int, int]]:
    """The quoted string at ``at`` with its spot, and those added to it with ``+``: one value in several spots."""
    out: list[tuple[str, int, int]] = []
    for m in QUOTED.finditer(line, at):
        if out and not re.fullmatch(r"[\"'`]\s*(?:\+|\.|" + ",|" * macro + r")\s*[\"'`]", line[out[-1][2]:m.start() + 1]):
            break
        out.append((m[1] or m[2] or m[3] or "", m.start() + 1, m.end() - 1))
    return out


def line_spots(line: str, plain: bool) -> list[tuple[int, int]]:
    """Spots of credentials in a line, as (start, end). ``plain``: settings of this file need no quotes."""
    out: list[tuple[int, int]] = []
    urls = [(m.start(), m.end()) for m in URL.finditer(line)]
    for m in URL.finditer(line):
        if len(m[3]) >= 3 and not excluded(m[3]) and not PLACEHOLDER.search(m[2] or "user"):
            out.append(m.span(3))
    for m in HEADER.finditer(line):
        v = m[2]
        if m[1] == "Basic":
            try:
                ok = ":" in base64.b64decode(v + "=" * (-len(v) % 4)).decode("utf-8")
            except ValueError:
                ok = False
        else:
            ok = bool(re.fullmatch(PREFIXED, v)) or (len(v) >= 16 and randomness(v) > 0.8 and bool(re.search(r"\d", v)))
        if ok and not excluded(v):
            out.append(m.span(2))
    for m in QUERY.finditer(line):
        if len(m[1]) >= 10 and not excluded(m[1]) and (randomness(m[1]) > 0.8 and re.search(r"\d", m[1]) or re.fullmatch(PREFIXED, m[1])):
            out.append(m.span(1))
    for m in USER.finditer(line):
        if len(m[1]) >= 6 and not excluded(m[1]):
            out.append(m.span(1))
    for m in CALL.finditer(line):
        if named_secret(m[1]):
            out.append(m.span(1))
    for m in re.finditer(r"(?<![\w/+.-])(?:" + PREFIXED + r")(?![\w/+=])", line):
        if not excluded(m[0]) and randomness(m[0]) > 0.6:
            out.append(m.span())
    comment = COMMENT.search(line)
    if comment or plain:
        for m in NOTE.finditer(line, comment.start() if comment else 0):
            v = m[1].rstrip(".,;:)")
            if note_secret(v) and not (any(a <= m.start(1) < b + 1 for a, b in urls) or "://" in v):
                out.append((m.start(1), m.start(1) + len(v)))
    for m in re.finditer(r"""(?<![\w.\-])(?:(?![A-Za-z_])[\w.\-])*+([A-Za-z_][\w.\-]*+)["']?\s*(?::\s*[&\w' ]+?=|:=|=>|=|:)\s*(?=["'`\S])""", line):
        name = m[1]
        if not NAME.search(CAMEL.sub("_", name)):
            continue
        at = m.end()
        macro = line.startswith("concat!(", at)
        if macro or line[at:at + 1] in ("", '"', "'", "`"):
            pieces = parts_from(line, at, macro)
            value = "".join(p[0] for p in pieces)
            if named_secret(value) and not URL.search(value):
                out += [(a, b) for _, a, b in pieces]
        elif plain:
            v = re.split(r"\s" if line[at - 1] == "=" else r"\s+[#;]|\s*$", line[at:], maxsplit=1)[0]
            if named_secret(v) and not URL.search(v):
                out.append((at, at + len(v)))
    return out


def data_row(text: str, at: int, end: int) -> bool:
    """Whether a string stands alone on its line, beside another such line: data in several rows."""
    a, b = text.rfind("\n", 0, at) + 1, text.find("\n", end)
    b = len(text) if b < 0 else b
    if ROW.fullmatch(text, a, b) is None:
        return False
    before = a > 0 and ROW.fullmatch(text, text.rfind("\n", 0, a - 1) + 1, a - 1)
    after = text.find("\n", b + 1)
    return bool(before or b < len(text) and ROW.fullmatch(text, b + 1, len(text) if after < 0 else after))


def string_spots(text: str, plain: bool) -> list[tuple[int, int]]:
    """Spots of the quoted strings and long tokens of a text that look random, whatever their setting is called.

    Outside of strings and comments, a token of a file that isn't ``plain`` is a name.
    """
    out = []
    for m in STRING.finditer(text):
        at, end = m.span("v" if m["v"] is not None else "t")
        value = text[at:end]
        if LETTER.search(value) is None or DIGIT.search(value) is None and (value.islower() or value.isupper()):
            continue  # neither words nor numbers are random
        before = text[max(0, at - 48):at].rpartition("\n")[2]
        if "base64," in value or DATA.search(before[:-1] if m["v"] is not None else before):
            continue
        named = KEYED.search(before) is not None
        if m["v"] is not None and ("://" in value or "=" in value.rstrip("=")) and not data_row(text, at, end):
            inner = [x for x in INNER.finditer(value) if looks_random(x[0], KEYED.search(value[max(0, x.start() - 24):x.start()]) is not None)]
            if inner and not named:
                out += [(at + x.start(), at + x.end()) for x in inner]
                continue
        if looks_random(value, named) and not data_row(text, at, end):
            head = text[text.rfind("\n", 0, at) + 1:at] if m["v"] is None and not plain else ""
            if m["v"] is not None or plain or COMMENT.search(head) or any(q in head for q in "\"'`"):
                out.append((at, end))
    return out


def found_spots(text: str, path: str) -> list[tuple[int, int]]:
    """Spots of credentials in a text, as sorted (start, end) without overlaps; key blocks in full, line by line."""
    plain = not path.lower().endswith(QUOTING)
    spots = set(string_spots(text, plain))
    seen = -1
    for at, kind in spotter().iter(text):
        if at < seen:
            continue
        if kind == 1:
            tail = WORD_TAIL.match(text, at + 1)
            if tail is None or not plain and tail["q"] is None and tail["note"] is None and text[tail.end() - 2:tail.end() - 1] != "(":
                continue
        elif kind == 2 and URL_TAIL.match(text, at + 1) is None:
            continue
        a, b = text.rfind("\n", 0, at) + 1, text.find("\n", at + 1)
        b = len(text) if b < 0 else b
        seen = b
        line = text[a:b]
        if "PRIVATE KEY" in line and (BEGIN.search(line) or END.search(line)):
            spots |= block_spots(text, a, line)
        spots |= {(a + x, a + y) for x, y in line_spots(line, plain)}
    out: list[tuple[int, int]] = []
    for x, y in sorted(spots):
        if out and x < out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        elif y > x:
            out.append((x, y))
    return out


def block_spots(text: str, at: int, line: str) -> set[tuple[int, int]]:
    """The lines of a key block that has its BEGIN or END line at ``at``; a block cut by the text counts as far as it is there."""
    def one(a: int) -> tuple[int, int]:
        b = text.find("\n", a)
        return a, len(text) if b < 0 else b

    whole, first, begin = set(), END.search(line), BEGIN.search(line)
    cut = first is not None and (begin is None or first.start() < begin.start())
    while begin and (end := END.search(line, begin.end())):
        body = line[begin.end():end.start()]
        if len(re.sub(r"\\n|\s", "", body)) >= 16 and not PLACEHOLDER.search(body.strip()):
            whole.add((at + begin.start(), at + end.end()))
        begin = BEGIN.search(line, end.end())
    if begin:
        whole |= begun_block(text, at, one)
    return whole | ended_block(text, at, one) if cut else whole


def begun_block(text: str, at: int, one: Callable[[int], tuple[int, int]]) -> set[tuple[int, int]]:
    """The lines of a key block from the line at ``at``, which has its BEGIN."""
    out, a = [], at
    while True:
        x, y = one(a)
        row = text[x:y]
        out.append((x, y))
        if x != at and (END.search(row) or not BODY.match(row.rstrip("\r"))):
            if not END.search(row):
                out.pop()
            break
        if y >= len(text):
            break
        a = y + 1
    if any("ENCRYPTED" in text[x:y] for x, y in out[:3]):
        return set()
    return set(out) if len(out) > 1 or y >= len(text) else set()


def ended_block(text: str, at: int, one: Callable[[int], tuple[int, int]]) -> set[tuple[int, int]]:
    """The lines of a key block that the text begins within, up to the line at ``at``, which has its END."""
    out, a = [one(at)], at
    while a > 0:
        a = text.rfind("\n", 0, a - 1) + 1
        x, y = one(a)
        row = text[x:y]
        if BEGIN.search(row):
            return set()
        if not BODY.match(row.rstrip("\r")):
            return set()
        out.append((x, y))
    return set(out)


def found_lines(chunks: DataFrame) -> DataFrame:
    """``chunk_id, line_no``: each line of a chunk that carries part of a credential, once.

    Texts go through the scan in Arrow batches where they are read; only the found lines are shuffled, to remove repeats.
    Null texts have no lines, a null start counts from line 1; columns of any other names are ignored.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, lines = [], []
            for cid, path, start, text in zip(batch.chunk_id, batch.path, batch.start_line, batch.text):
                first = 1 if start is None or start != start else int(start)
                for no in {text.count("\n", 0, x) for x, _ in found_spots(text, path or "")}:
                    ids.append(cid)
                    lines.append(first + no)
            yield pd.DataFrame({"chunk_id": pd.Series(ids, dtype="int64"), "line_no": pd.Series(lines, dtype="int32")})

    rows = chunks.filter("text IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", "path", "start_line", "text")
    return rows.mapInPandas(scan, "chunk_id long, line_no int").distinct()


def redacted(chunks: DataFrame) -> DataFrame:
    """``chunk_id, masked, text`` of the chunks with a credential: the text with each credential's characters as ``*``.

    Everything else stays, so quotes, escapes, lines and lengths are as before. Repeated rows come out once.
    """

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for cid, path, text in zip(batch.chunk_id, batch.path, batch.text):
                if spots := found_spots(text, path or ""):
                    out, at = [], 0
                    for x, y in spots:
                        out += [text[at:x], re.sub(r"[A-Za-z0-9+/=]", "*", text[x:y]) if "-----" in text[x:y] else re.sub(r"[^\s]", "*", text[x:y])]
                        at = y
                    rows.append((cid, len(spots), "".join(out) + text[at:]))
            yield pd.DataFrame(rows, columns=["chunk_id", "masked", "text"])

    rows = chunks.filter("text IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", "path", "text")
    return rows.mapInPandas(mask, "chunk_id long, masked int, text string").dropDuplicates(["chunk_id", "text"])
