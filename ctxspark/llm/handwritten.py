"""Problem 2: files that nobody wrote by hand in their repository: tool output, minified, vendored, data dumps.

Vendored copies are found by Merkle hashes, bottom-up from the blocks of each file over the repository's directory tree: subtrees whose
hash occurs in unrelated repositories, and files mostly made of such blocks, were brought in. Headers, names and the layout
of the text mark the other kinds, and vendored copies that occur once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.session import materialise

# Names that tools give to their output.
TOOL_NAMES = r"(?:\.min\.(?:js|css|mjs|cjs)|[-_.]lock\.json|-lock\.ya?ml|\.lock|_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|rs)|\.pb\.gw\.go|\.generated\.\w+|\.g\.(?:dart|cs)|_generated\.\w+|\.designer\.cs|Grpc\.java|OuterClass\.java|\.bundle\.js|go\.sum|\.map)$"
# Folders that hold tool output or other people's packages (a package folder with its name must follow).
TOOL_FOLDERS = r"(?:^|/)(?:__generated__|gen|build-out|dist|\.next|target/generated-sources)/"
VENDOR_FOLDERS = r"(?:^|/)(?:vendor|_vendor|third[_-]party|thirdparty|external|deps|node_modules|bower_components|Pods|site-packages)/[^/]+/|(?:^|/)lib/[A-Za-z][\w]*-\d+(?:\.\d+)+/"
CODE = re.compile(r"\.(?:py|js|mjs|cjs|ts|mts|jsx|tsx|go|rs|java|css|scss|c|h|cc|cpp|cs|rb|php|kt|swift|sh)$")
MADE = re.compile(
    r"(?i)\bcode generated by (?!hand\b)[\w.\-]+.*\bdo not edit|@generated\b|\bauto-?generated\b(?! ids)|\bautomatically (?:generated|created|produced)|\bmachine[- ](?:written|generated|made)\b"
    r"|\bthis file (?:was|is|has been) (?:auto\w*[- ])?(?:generated|produced|created|written|built|emitted) (?:by|from)\b|\bgenerated by (?!hand\b)[\w.\-]+ (?:v?\d|from\b|on\b)|\bchanges (?:will|would) be (?:lost|overwritten)"
    r"|\bedits? (?:will|would) be (?:lost|overwritten)|\b(?:wurde|wird|durch|von) (?:automatisch|\w+)(?: \w+)? (?:erzeugt|generiert|erstellt)\b|\bg[ée]n[ée]r[ée] (?:automatiquement|par)\b"
    r"|\bgenerado (?:autom[áa]ticamente|por)\b|\bсгенерирован|自动生成|自動生成|<auto-generated")  # fmt: skip
BROUGHT = re.compile(
    r"(?i)^\W*(?:upstream|origin|source|home ?page|repository)\s*:\s*https?://|\b(?:taken|copied|vendored|imported|adapted|ported|borrowed|mirrored|derived)\b.*\bfrom\b.*https?://"
    r"|(?:\(c\)|©|\bcopyright\b).*\b(?:authors|contributors|developers|maintainers)\b"
    r"|^\W*[\w.@/-]+\s+(?:[-–—|:]+\s*)?(?:version\s|release\s|v)?\s*\d+\.\d+[\w.]*\s*(?:$|[|(]|[-–—]\s)|^/\*!\s*[\w.@/-]+\s+v?\d+\.\d")  # fmt: skip
VALUES = re.compile(r"""^[ \t]*(?:(?:0[xX][0-9a-fA-F]+|-?\d[\d.eE_+-]*|"[^"\\\n]*"|'[^'\\\n]*'|\\x[0-9a-f]{2})[ \t]*,?[ \t]*)+\r?$""", re.M)
DUMP_CHARS, DUMP_SHARE = 1000, 0.8
#: The least block that is a leaf of the tree, and the share of a file's leaves that marks it as a copy.
LEAF_LINES, LEAF_CHARS, COPY_SHARE = 3, 50, 0.5
NOTE = re.compile(r"\s*(?://|#(?!\[)|/\*|\*|--|<!--|;)")
#: Parts into which the rows of one leaf fall where copies are looked up: a block that a third of all files hold is no one task's.
SALTS = 16


def header_of(text: str) -> list[str]:
    """The lines of the comments, and of a doc string, that stand before a text's first code."""
    out: list[str] = []
    until, at = "", 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        x, at = text[at:end].strip(), end + 1
        if until:
            out.append(x)
            until = "" if until in x else until
        elif not x or x.startswith(("#!", "'use strict'", '"use strict"', "<?php", "package ")) and not out:
            continue
        elif x.startswith("/*"):
            out.append(x)
            until = "" if "*/" in x[2:] else "*/"
        elif x.startswith(('"""', "'''")):
            out.append(x)
            until = "" if x[:3] in x[3:] else x[:3]
        elif x.startswith(("//", "#", "--", "<!--", ";")):
            out.append(x)
        else:
            break
    return out


def leaves_of(text: str) -> list[tuple[int, int]]:
    """``(hash, characters)`` of the blocks of a source: definitions and runs of lines, without comments and blanks.

    A block starts at a line that isn't indented, or after an empty line at top level. Blocks below ``LEAF_LINES`` lines or
    ``LEAF_CHARS`` characters say nothing about where they come from and are left out.
    """
    out: list[tuple[int, int]] = []
    block: list[str] = []

    def close() -> None:
        if len(block) >= LEAF_LINES:
            body = "\n".join(block)
            if len(body) >= LEAF_CHARS:
                out.append((xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63), len(body)))
        block.clear()

    for line in text.split("\n"):
        body = "".join(line.split())
        if not body or NOTE.match(line):
            continue
        if line[0] not in " \t})]":
            close()
        block.append(body)
    close()
    return list(dict.fromkeys(out))


def chunk_marks(chunks: DataFrame) -> DataFrame:
    """Per chunk: ``chars, value_chars, lines, blanks, made, brought``, ``digest``, a hash of place and text, and ``leaves``."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, start, text in zip(batch.path, batch.start_line, batch.text):
                lines = text.count("\n") + 1
                code = bool(CODE.search(path))
                values = sum(len(m[0]) for m in VALUES.finditer(text)) if code and text.count("(") * 8 < lines + 8 else 0
                head = header_of(text) if code and start == 1 else []
                leaves = leaves_of(text) if code else []
                rows.append((len(text), values, lines, text.count(" ") + text.count("\n"), any(map(MADE.search, head)), any(map(BROUGHT.search, head)),
                             [{"leaf": h, "n": n} for h, n in leaves]))
            out = pd.DataFrame(rows, columns=["chars", "value_chars", "lines", "blanks", "made", "brought", "leaves"])
            yield pd.concat([batch[["repo_id", "path", "start_line", "digest"]].reset_index(drop=True), out], axis=1)

    rows = chunks.filter("text IS NOT NULL AND path IS NOT NULL AND repo_id IS NOT NULL").select(
        "repo_id", "path", F.coalesce("start_line", F.lit(1)).alias("start_line"), "text")
    rows = rows.withColumn("digest", F.xxhash64("start_line", F.replace("text", F.lit("\r"), F.lit(""))))
    return rows.mapInPandas(look, "repo_id string, path string, start_line int, digest long, chars long, value_chars long, lines long, blanks long, made boolean, brought boolean, leaves array<struct<leaf:long,n:int>>")


def file_marks(chunks: DataFrame) -> DataFrame:
    """The marks of all chunks of a file together; repeated chunks once.

    ``leaves`` are its distinct blocks, ``content`` is its hash: of its leaves, so that another header or layout changes nothing, or of
    its text where it has none.
    """
    part = F.struct("start_line", "digest", "chars", "value_chars", "lines", "blanks", "made", "brought", "leaves")
    files = chunk_marks(chunks).groupBy("repo_id", "path").agg(F.collect_set(part).alias("_p"))
    total = lambda c: F.aggregate("_p", F.lit(0).cast("long"), lambda s, p: s + p[c])
    leaves = F.array_distinct(F.flatten(F.transform("_p", lambda p: p["leaves"])))
    own = F.xxhash64(F.array_sort(F.transform("_p", lambda p: p["digest"])))
    files = files.select(
        "repo_id", "path", *[total(c).alias(c) for c in ("chars", "value_chars", "lines", "blanks")],
        F.exists("_p", lambda p: p["made"]).alias("made"), F.exists("_p", lambda p: p["brought"]).alias("brought"), leaves.alias("leaves"), own.alias("_own"))
    hashed = F.xxhash64(F.array_sort(F.transform("leaves", lambda x: x["leaf"])))
    return files.withColumn("content", F.when(F.size("leaves") > 0, hashed).otherwise(F.col("_own"))).drop("_own")


def _sum_of(digest: str) -> Column:
    """An order-free hash of many hashes; a plain sum and a bitwise sum, so that it is aggregated before the shuffle."""
    return F.xxhash64(F.sum(F.col(digest).cast("decimal(38,0)")), F.bit_xor(digest), F.count(digest))


def _common(nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (``hash, family``) whose hash occurs in more than one family.

    Families are counted by least and greatest, before the shuffle; what is looked up is salted.
    """
    several = nodes.groupBy("hash").agg(F.min("family").alias("_a"), F.max("family").alias("_b")).filter("_a <> _b").select("hash")
    salted = several.select("hash", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
    return nodes.withColumn("_salt", F.pmod(F.xxhash64("repo_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "_salt"], "left_semi").drop("_salt")


def shared_files(files: DataFrame) -> DataFrame:
    """``repo_id, path, shared``: files brought in by unrelated repositories, by Merkle hashes from blocks up to directories.

    Leaves are blocks; a file's hash covers its leaves, a directory's those of its children, level by level from the deepest, names
    left out. Subtrees that occur in unrelated repositories are copies, with all files in them, and so are files
    of which at least ``COPY_SHARE`` of the characters lie in such leaves. Repositories with the same root hash are copies of one another,
    so related. Empty and tiny files don't count, they are alike everywhere; a source without a leaf counts as a whole.
    """
    deep = files.agg(F.max(F.size(F.split("path", "/"))).alias("d")).first()["d"] or 0
    depth = F.size(F.split("path", "/"))
    small = F.when(F.col("path").rlike(CODE.pattern) & (F.col("chars") >= LEAF_CHARS), F.col("chars")).otherwise(0)
    weight = F.when(F.size("leaves") > 0, F.aggregate("leaves", F.lit(0).cast("long"), lambda s, x: s + x["n"])).otherwise(small)
    node = files.select("repo_id", "path", F.col("content").alias("hash"), weight.alias("chars"))
    roots = node.groupBy("repo_id").agg(_sum_of("hash").alias("root"))
    family = materialise(roots.groupBy("root").agg(F.min("repo_id").alias("family")).join(roots, "root").select("repo_id", "family"))
    nodes, below = [node], None
    for level in range(deep, 1, -1):
        here = node.filter(depth == level)
        here = here if below is None else here.unionByName(below)
        below = here.groupBy("repo_id", F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(_sum_of("hash").alias("hash"), F.sum("chars").alias("chars"))
        nodes.append(below)
    trees = nodes[0]
    for n in nodes[1:]:
        trees = trees.unionByName(n)
    trees = materialise(trees.filter("chars > 0").join(family, "repo_id"))
    found = _common(trees).select("repo_id", F.col("path").alias("tree"))
    above = node.withColumn("_at", F.explode(F.sequence(F.lit(1), depth))).select(
        "repo_id", "path", F.expr("substring_index(path, '/', _at)").alias("tree"))
    whole = above.join(found, ["repo_id", "tree"], "left_semi").select("repo_id", "path").distinct().withColumn("shared", F.lit(1.0))
    leaves = files.select("repo_id", "path", F.explode("leaves").alias("_l")).select("repo_id", "path", F.col("_l.leaf").alias("hash"), "_l.n").join(family, "repo_id")
    held = _common(leaves).groupBy("repo_id", "path").agg(F.sum("n").alias("_held"))
    parts = held.join(node, ["repo_id", "path"]).select("repo_id", "path", (F.col("_held") / F.col("chars")).alias("shared"))
    return whole.unionByName(parts).groupBy("repo_id", "path").agg(F.max("shared").alias("shared")).filter(F.col("shared") >= COPY_SHARE)


def marks(chunks: DataFrame) -> DataFrame:
    """``repo_id, path, copied, generated, vendored, dump, minified``: what each means says of each file on its own.

    ``copied`` is by Merkle hashes alone; the others are by headers, names, folders and layout. Null texts, paths and repositories
    have no row; repeated chunks count once.
    """
    files = materialise(file_marks(chunks))
    code = F.col("path").rlike(CODE.pattern)
    wide = F.col("chars") / F.col("lines")
    copies = shared_files(files).select("repo_id", "path", F.lit(True).alias("copied"))
    return files.join(copies, ["repo_id", "path"], "left").select(
        "repo_id", "path", F.coalesce("copied", F.lit(False)).alias("copied"),
        (F.col("path").rlike(TOOL_NAMES) | code & (F.col("made") | F.col("path").rlike(TOOL_FOLDERS))).alias("generated"),
        (code & F.col("brought") | F.col("path").rlike(VENDOR_FOLDERS)).alias("vendored"),
        ((F.col("value_chars") >= DUMP_CHARS) & (F.col("value_chars") >= DUMP_SHARE * F.col("chars"))).alias("dump"),
        (code & (F.col("chars") >= 300) & (wide > 110) & (F.col("blanks") < 0.12 * F.col("chars"))).alias("minified"))


def not_handwritten(chunks: DataFrame) -> DataFrame:
    """``repo_id, path, reason, copied`` of each file that is tool output, minified, vendored, or a data dump saved as code.

    ``reason`` is the first that holds; ``copied`` says whether the Merkle hashes alone find the file too.
    """
    reason = F.when(F.col("generated"), "generated").when(F.col("vendored"), "vendored").when(F.col("copied"), "copied").when(F.col("dump"), "data dump").when(F.col("minified"), "minified")
    return marks(chunks).withColumn("reason", reason).filter("reason IS NOT NULL").select("repo_id", "path", "reason", "copied")
