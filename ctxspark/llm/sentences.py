"""Problem 8: sentences of documents in all their languages and scripts.

Blocks (paragraphs, headings, list items; no fenced code) are found first, then candidate boundaries in them. Marks of one
meaning, and the spaces of scripts without marks, decide themselves; a full stop before a space is classified by maximum entropy.
Its features compare a token's use before stops, and the next token's use after them, with their use at the ends and starts of
blocks, counted over all documents: an abbreviation hardly ever ends a block, a surname hardly ever starts one. The
classifier is trained on reliable boundaries (ends of blocks) and reliable non-boundaries (stops before small words).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.session import materialise

#: Labelled rows that the classifier is fitted on, at most; the counts behind its features cover all documents.
TRAINING_ROWS = 100_000
#: Log odds from which the tokens of a stop are a label for the second classifier; parts of a join on tokens.
SURE, SALTS = 2.0, 8

# Marks, closers and openers.
CJK_MARKS, OTHER_MARKS, STOP = "。！？｡︒", "!?؟۔।॥‼⁇⁈⁉։።", "."
OPENERS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "‹": "›", "‚": "‘", "〈": "〉"}
CLOSERS = "”»」』)）]】》›〉\"’'“"
FENCE = re.compile(r"[ \t]*(?:>[ \t]*)*(`{3,}|~{3,})")
HEADING = re.compile(r"([ \t]{0,3}#{1,6}[ \t]+)(.*?)(?:[ \t]+#+)?[ \t\r]*$")
ITEM = re.compile(r"[ \t]*(?:>[ \t]*)*(?:[-*+•‣◦][ \t]+|\d{1,9}[.)][ \t]+)+(?:\[[ xX]\][ \t]+)?")
RULE = re.compile(r"[ \t]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|=+[ \t]*|-+[ \t]*)\r?$")
QUOTE = re.compile(r"[ \t]*(?:>[ \t]?)+")
MAY_FENCE, MAY_ITEM = "`~>", "-*+•‣◦>"
CODE_SPAN = re.compile(r"(`+)(?!`)[^\n]*?(?:\n[^\n]+?)?(?<!`)\1(?!`)")
URL = re.compile(r"(?:https?|ftp)://[^\s<>\"“”«»「」（）。！？]+")
CANDIDATE = re.compile(r"[.!?؟۔।॥‼⁇⁈⁉։።。！？｡︒]+(?:[   ]?[!?؟]+)*")
THAI = "฀-๿຀-໿ក-៿က-႟"
THAI_GAP = re.compile(rf"(?<=[{THAI}ฯๆ])[ \t\n\r ]+(?=[{THAI}])")
THAI_ANY = re.compile(rf"[{THAI}]")
MIXED_GAP = re.compile(rf"(?<=[{THAI}ฯๆ])[ \t\n\r]+(?=[A-Za-z0-9])")
SMALL = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*(?=\s|[,.;:!?)\]»”\"…]+(?:\s|$)|$)")


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """``(start, end, is a heading)`` of the blocks of a text, white space at their ends left out."""
    out: list[tuple[int, int, bool]] = []
    at, fence, start, last, item = 0, "", -1, -1, False

    def close(heading: bool = False) -> None:
        nonlocal start
        if start >= 0 and last > start:
            out.append((start, last, heading))
        start = -1

    for line in text.split("\n"):
        end = at + len(line)
        mark = line.lstrip()[:1]  # what a line is begins with few signs; the patterns run only on those
        m = FENCE.match(line) if mark in MAY_FENCE else None
        if fence:
            if m and m[1].startswith(fence) and not line[m.end():].strip():
                fence = ""
        elif m and not (m[1][0] == "`" and "`" in line[m.end():]):
            close()
            fence = m[1]
        elif not mark:
            close()
        elif mark == "#" and (h := HEADING.match(line)):
            close()
            if h[2].strip():
                out.append((at + h.start(2), at + h.start(2) + len(h[2].rstrip()), True))
        elif mark in "-*_=" and RULE.match(line) and (start < 0 or mark in "=-"):
            close(start >= 0 and not item)
            item = False
        else:
            m = ITEM.match(line) if mark in MAY_ITEM or mark.isdigit() else None
            if m and start >= 0 and not item and (n := re.search(r"\d+", m[0])) and n[0] != "1":
                m = None  # only a list that starts with 1 may follow a paragraph's line
            item = bool(m) or item and start >= 0
            if m:
                close()
                lead = m.end()
            else:
                q = QUOTE.match(line) if mark == ">" else None
                lead = q.end() if q else len(line) - len(line.lstrip())
            body = line.rstrip()
            if start < 0 and len(body) > lead:
                start = at + lead
            if start >= 0 and len(body) > lead:
                last = at + len(body)
        at = end + 1
    close()
    return out


@lru_cache(maxsize=200_000)
def token_class(token: str) -> str:
    """A token as the counts know it: code, paths and numbers by kind, words as they are."""
    token = token.strip("\"'“”„«»‹›()（）[]*_…,;:").removesuffix(".")
    if "`" in token:
        return "`"
    if re.fullmatch(r"[vV]?\d[\d.,:%]*", token):
        return "9" if token[0].isdigit() and "." not in token else "9.9" if token[0].isdigit() else "v9"
    if "://" in token or re.search(r"[/_]|\w\(\)|[a-z][A-Z]|[A-Za-z]\w+\.\w{1,}", token) and token.isascii():
        return "<code>" if re.search(r"[./]", token) else "<name>"
    return re.sub(r"\d+", "9", token)


TOKEN = re.compile(r"\S+")


def first_token(s: str, at: int = 0) -> str:
    """The class of the first token of a text from a place on."""
    m = TOKEN.search(s, at)
    return token_class(m[0].rstrip(".!?,;:")) if m else ""


def last_token(s: str, end: int | None = None) -> str:
    """The class of the last token of a text that ends before a stop."""
    end, width = len(s) if end is None else end, 64
    while True:  # a longer look back where one token fills it
        words = s[max(0, end - width):end].split()
        if len(words) > 1 or width >= end:
            return token_class(words[-1]) if words else ""
        width *= 8


BRACKETS = re.compile("[" + re.escape("".join({*OPENERS, *OPENERS.values(), *")）]】」』”»", '"'})) + "]")


def quoted_depth(block: str) -> list[tuple[int, int]]:
    """``(start, end)`` of the outermost quotations and brackets; marks without a partner don't count."""
    spans, stack = [], []
    straight = [m.start() for m in re.finditer('"', block)]
    pair = dict(zip(straight[::2], straight[1::2]))
    ends = set(pair.values())
    for m in BRACKETS.finditer(block):
        i, c = m.start(), m[0]
        if i in pair:
            stack.append(('"', i))
        elif i in ends:
            while stack:
                c0, s = stack.pop()
                if c0 == '"':
                    spans.append((s, i + 1))
                    break
        elif stack and c == OPENERS.get(stack[-1][0]):
            spans.append((stack.pop()[1], i + 1))
        elif c in OPENERS and not (c == "“" and stack and stack[-1][0] == "„"):
            stack.append((c, i))
        elif c in ")）]】」』”»":
            for n in range(len(stack) - 1, -1, -1):
                if OPENERS.get(stack[n][0]) == c:
                    spans.append((stack[n][1], i + 1))
                    del stack[n:]
                    break
    spans.sort()
    outer: list[tuple[int, int]] = []
    for s, e in spans:
        if not outer or s >= outer[-1][1]:
            outer.append((s, e))
    return outer


def small_word(s: str, at: int = 0) -> bool:
    """Whether a text goes on with a plain word in small letters."""
    m = SMALL.match(s, at)
    return bool(m) and m[0].islower()


#: What a candidate is, as bits of a number: the kind of mark, white space after it, the next letter's case, digits, script, quotation.
STOPS, ASKS, WIDE, BLANK_ONLY, GAP, SMALL_NEXT, CAPITAL_NEXT, DIGIT_NEXT, QUOTED, UNSPACED, DOTTED = (1 << n for n in range(11))
SPAN = re.compile(r"[\"“„«「『(（\[【《‹]")
AFTER = re.compile(r"\S")
LEADS = CJK_MARKS + OTHER_MARKS + STOP + "”」』）)\"»"


def candidates(block: str) -> list[tuple[int, int, int, int, str, str]]:
    """``(end, next start, label, flags, token before, token after)`` of the candidate boundaries in a block.

    Label 1 is a reliable boundary, -1 reliably none, 0 neither. Tokens are given for full stops only.
    """
    masked = block
    for rx in (CODE_SPAN, URL):
        def blank(m: re.Match) -> str:
            keep = re.search(r"[.,;:!?)\]]+$", m[0]) if rx is URL else None
            return "\x02" * (len(m[0]) - (len(keep[0]) if keep else 0)) + (keep[0] if keep else "")
        if (rx is URL and "://" in masked) or (rx is CODE_SPAN and "`" in masked):
            masked = rx.sub(blank, masked)
    spans = quoted_depth(masked) if SPAN.search(masked) else []
    out = []
    si, n = 0, len(block)
    for m in CANDIDATE.finditer(masked):
        i, j = m.span()
        while si < len(spans) and spans[si][1] <= i:
            si += 1
        inside = si < len(spans) and spans[si][0] < i < spans[si][1]
        end = j
        bracket = ""
        if inside:
            s, e = spans[si]
            if block[j:e].strip() and not all(c in CLOSERS or c.isspace() for c in block[j:e]):
                continue
            end, bracket = e, block[s]
            k = s
            while k > 0 and block[k - 1].isspace():
                k -= 1
            leads = k == 0 or block[k - 1] in LEADS
        while end < n and block[end] in CLOSERS and not (block[end] in "\"“" and end + 1 < n and not block[end + 1].isspace()):
            end += 1
        found = AFTER.search(block, end)
        if found is None:
            continue
        nxt = found.start()
        gap = nxt > end
        sign = m[0].strip()
        mark = sign[-1]
        wide = mark in CJK_MARKS
        if not gap and not wide:
            continue
        lower = block[nxt].islower() and small_word(block, nxt)
        k = nxt
        while k < n and block[k] in "“„«\"'(¿¡[":
            k += 1
        cased = block[k:k + 1]
        flags = (WIDE if wide else ASKS if mark in OTHER_MARKS else STOPS) | GAP * gap | SMALL_NEXT * lower | CAPITAL_NEXT * cased.isupper() | DIGIT_NEXT * cased.isdigit()
        flags |= QUOTED * bool(inside) | UNSPACED * (cased >= "\u0e00" and not cased.isupper() and not cased.islower() and cased.isalpha()) | DOTTED * (sign != "." and mark == ".")
        if inside:
            sure = leads and not lower and (gap or wide) if bracket in "(（[【" else cased.isupper() and gap and not lower
            out.append((end, nxt, 1 if sure else -1, flags | (0 if sure else BLANK_ONLY), "", ""))
        elif wide or mark in OTHER_MARKS:
            sure = wide or not lower or mark in "।॥۔։።"
            out.append((end, nxt, 1 if sure else -1, flags, "", ""))
        elif sign != "." and lower:
            out.append((end, nxt, -1, flags, "", ""))
        else:
            out.append((end, nxt, -1 if lower else 0, flags, last_token(block, i), first_token(block, nxt)))
    if not block.isascii() and THAI_ANY.search(masked):
        out += thai_gaps(masked, spans)
    return sorted(out)


def thai_gaps(masked: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int, str, str]]:
    """The candidates of scripts without marks: white space between their letters, and before others."""
    out = []
    for m in THAI_GAP.finditer(masked):
        if not any(s < m.start() < e for s, e in spans):
            out.append((m.start(), m.end(), 1, BLANK_ONLY | GAP | UNSPACED, "", ""))
    for m in MIXED_GAP.finditer(masked):
        after = masked[m.end()]
        out.append((m.start(), m.end(), -1, BLANK_ONLY | GAP | DIGIT_NEXT * after.isdigit() | CAPITAL_NEXT * after.isupper(), "", ""))
    return out


BLOCKS = (
    "doc_id long, text_hash long, start_char int, end_char int, first string, last string, following string, "
    "ends array<int>, nexts array<int>, labels array<int>, flags array<int>, befores array<string>, afters array<string>")  # fmt: skip


def found_blocks(documents: DataFrame) -> DataFrame:
    """One row per block with its candidates; ``last`` is the token before a closing stop, ``following`` starts the next block.

    Null texts and texts without letters outside fenced code have none.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, code, text in zip(batch.doc_id, batch.text_hash, batch.text):
                spans = blocks(text)
                firsts = [first_token(text, s) for s, _, _ in spans] + [""]
                for n, (s, e, heading) in enumerate(spans):
                    block = text[s:e]
                    tail = block.rstrip(CLOSERS)
                    last = last_token(tail, len(tail) - 1) if tail.endswith(".") and not tail.endswith("..") else ""
                    found = () if heading else candidates(block)
                    rows.append((doc, code, s, e, firsts[n], last, firsts[n + 1], [s + c[0] for c in found], [s + c[1] for c in found], *([c[x] for c in found] for x in range(2, 6))))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in BLOCKS.split(", ")])

    rows = documents.filter("doc_id IS NOT NULL AND length(trim(text)) > 0").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInPandas(look, BLOCKS)


def once_per_document(found: DataFrame) -> DataFrame:
    """The blocks of one text for each ``doc_id``: of several texts under one id, the one of the least hash. Repeats drop out later."""
    several = found.groupBy("doc_id").agg(F.min("text_hash").alias("_a"), F.max("text_hash").alias("_b")).filter("_a <> _b")
    return found if several.isEmpty() else found.join(several, "doc_id", "left").filter("_a IS NULL OR text_hash = _a").drop("_a", "_b")


def token_counts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(before, after)``: how often each token stands before a stop and at the end of a block, after one and at the start."""
    inner = found.select(F.explode(F.arrays_zip("befores", "afters")).alias("c"))
    stops = inner.filter("c.befores <> ''").select(F.col("c.befores").alias("token"), F.lit(0).alias("edge"))
    ends = found.filter("last <> ''").select(F.col("last").alias("token"), F.lit(1).alias("edge"))
    starts = inner.filter("c.afters <> ''").select(F.col("c.afters").alias("token"), F.lit(0).alias("edge"))
    heads = found.filter("first <> ''").select(F.col("first").alias("token"), F.lit(1).alias("edge"))
    count = lambda df: df.groupBy("token").agg(F.sum("edge").alias("edge"), F.count("*").alias("n"))
    return count(stops.unionByName(ends)), count(starts.unionByName(heads))


def features(before: Column, n_before: Column, after: Column, n_after: Column, token: Column, rate_before: float, rate_after: float, own: int) -> list[Column]:
    """Features of a stop: log ratios of edge counts to what sentence ends would show, the lesser of both, shape and length.

    ``own`` is 1 for a row that is itself among the edge counts; it is left out of them then.
    """
    def ratio(edge: Column, n: Column, rate: float, own: int) -> Column:
        e, m = F.greatest(F.coalesce(edge, F.lit(0)) - own, F.lit(0)), F.greatest(F.coalesce(n, F.lit(0)) - own, F.lit(0))
        return F.greatest(F.least(F.log((e + 0.5) / (m * rate + 0.5)), F.lit(2.0)), F.lit(-4.0))

    x, y = ratio(before, n_before, rate_before, own), ratio(after, n_after, rate_after, own)
    return [F.lit(1.0), x, y, F.least(x, y), (F.length(token) == 1).cast("double"), (F.length(token) <= 3).cast("double"),
            token.rlike(r"\.").cast("double"), token.rlike(r"^v?9").cast("double"), token.rlike("^[<`]").cast("double")]


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of the maximum-entropy (logistic) classifier, by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def shape(flags: Column, tokens: Column) -> list[Column]:
    """Features of any candidate: mark, case, digits, script, gap and quotation, and for full stops what their tokens say."""
    bit = lambda *bits: (flags.bitwiseAND(F.lit(sum(bits))) == sum(bits)).cast("double")
    return [F.lit(1.0), tokens, *[bit(x) for x in (STOPS, ASKS, WIDE, BLANK_ONLY, GAP, SMALL_NEXT, CAPITAL_NEXT, DIGIT_NEXT, QUOTED, UNSPACED, DOTTED)],
            bit(WIDE, SMALL_NEXT), bit(STOPS, SMALL_NEXT), bit(BLANK_ONLY, UNSPACED), bit(BLANK_ONLY, QUOTED)]


def dot(x: Column, weights: np.ndarray) -> Column:
    """The weighted sum of features."""
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def sentences(documents: DataFrame) -> DataFrame:
    """``doc_id, start_char, end_char``: every sentence, as code point offsets, end exclusive.

    Two classifiers are fitted. The first tells stops that end a sentence from others by their tokens alone, on ends of blocks
    and on stops before small words. The second judges every candidate (stops, other marks, gaps, ends of quotations) by its
    shape and the first one's verdict, on the reliable candidates and on the stops that the first is sure of.
    Documents with a null or blank text, or only fenced code, have none; a repeated ``doc_id`` counts once.
    """
    found = once_per_document(materialise(found_blocks(documents)))
    before, after = (materialise(c) for c in token_counts(found))
    total = before.agg(F.sum("edge").alias("e"), F.sum("n").alias("n")).first()
    heads = after.agg(F.sum("edge").alias("e"), F.sum("n").alias("n")).first()
    rate_before, rate_after = ((r["e"] or 0) / max(r["n"] or 0, 1) for r in (total, heads))
    by_before = before.select(F.col("token").alias("before"), F.col("edge").alias("_be"), F.col("n").alias("_bn"))
    by_after = after.select(F.col("token").alias("after"), F.col("edge").alias("_ae"), F.col("n").alias("_an"))

    def with_features(rows: DataFrame, own: int) -> DataFrame:
        """The rows' features. Tokens that many rows share are joined in salted parts."""
        for side, column in ((by_before, "before"), (by_after, "after")):
            wide = side.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
            rows = rows.withColumn("_salt", F.floor(F.rand(1) * SALTS).cast("int")).join(wide, [column, "_salt"], "left").drop("_salt")
        return rows.withColumn("x", F.array(*features(F.col("_be"), F.col("_bn"), F.col("_ae"), F.col("_an"), F.col("before"), rate_before, rate_after, own)))

    half = TRAINING_ROWS // 2

    def weights_of(rows: DataFrame) -> np.ndarray | None:
        """Weights fitted on rows ``x, y, _h``: at most half of the training rows of each label, picked by hash.

        They are thinned by their count first, so that no task sorts more than about those.
        """
        counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        if len(counts) < 2:
            return None
        share = F.when(F.col("y") > 0, min(1.0, 1.5 * half / counts[1.0])).otherwise(min(1.0, 1.5 * half / counts[0.0]))
        thin = materialise(rows.filter(F.pmod("_h", F.lit(1_000_000)) < share * 1_000_000))
        labelled = pd.concat([thin.filter(F.col("y") == y).orderBy("_h", "x").limit(half).toPandas() for y in (1.0, 0.0)])
        return fitted(np.stack(labelled.x.to_numpy()), labelled.y.to_numpy())

    each = found.select("doc_id", "start_char", F.explode(F.arrays_zip("ends", "nexts", "labels", "flags", "befores", "afters")).alias("c")).select(
        "doc_id", "start_char", F.col("c.ends").alias("end"), F.col("c.nexts").alias("next"), F.col("c.labels").alias("label"), F.col("c.flags").alias("flags"),
        F.col("c.befores").alias("before"), F.col("c.afters").alias("after"), F.xxhash64("doc_id", "c.ends").alias("_h"))
    stops = materialise(with_features(each.filter("before <> '' OR after <> ''"), 0).select("doc_id", "start_char", "end", "next", "label", "flags", "x", "_h"))
    edges = found.filter("last <> '' AND following <> ''").select(F.col("last").alias("before"), F.col("following").alias("after"), F.xxhash64("doc_id", "end_char").alias("_h"))
    by_tokens = weights_of(with_features(edges, 1).select("x", F.lit(1.0).alias("y"), "_h").unionByName(stops.filter("label = -1").select("x", F.lit(0.0).alias("y"), "_h")))
    verdict = F.lit(0.0) if by_tokens is None else dot(F.col("x"), by_tokens)
    verdict = F.greatest(F.least(verdict, F.lit(8.0)), F.lit(-8.0))
    shaped = lambda df, tokens: df.withColumn("_t", tokens).withColumn("x", F.array(*shape(F.col("flags"), F.col("_t"))))
    every = shaped(stops, verdict).unionByName(shaped(each.filter("before = '' AND after = ''").drop("before", "after"), F.lit(0.0)))
    sure = F.when((F.col("label") == 1) | (F.col("label") == 0) & (F.col("_t") > SURE), 1.0).when((F.col("label") == -1) | (F.col("_t") < -SURE), 0.0)
    by_shape = weights_of(every.select("x", sure.alias("y"), "_h").filter("y IS NOT NULL"))
    cuts = every.filter("label = 1") if by_shape is None else every.filter(dot(F.col("x"), by_shape) > 0)
    if by_shape is None and by_tokens is None:
        cuts = every.filter("label >= 0")
    ends = found.select("doc_id", "start_char", F.col("end_char").alias("end"), F.lit(None).cast("int").alias("next"))
    per = cuts.select("doc_id", "start_char", "end", "next").unionByName(ends).groupBy("doc_id", "start_char").agg(F.array_sort(F.collect_set(F.struct("end", "next"))).alias("_c"))
    spans = F.transform("_c", lambda c, i: F.struct(F.when(i == 0, F.col("start_char")).otherwise(F.try_element_at("_c", i)["next"]).alias("s"), c["end"].alias("e")))
    return per.select("doc_id", F.explode(spans).alias("x")).select("doc_id", F.col("x.s").alias("start_char"), F.col("x.e").alias("end_char")).filter("start_char < end_char")
