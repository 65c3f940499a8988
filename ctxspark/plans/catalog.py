"""The registered queries on the given tables, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.functions.text import (
    BINARY_EXTENSIONS, FENCE_LANGUAGES, KEYWORD_STOP_WORDS, STOP_WORDS, bucket_of, candidate_id, extension,
    fence_language, keywords_of, lines_of, surrogate_tokens)
from ctxspark.functions.tokens import token_counter, token_slicer
from ctxspark.operators import budget, chunking, embedding, filters, graph, ranking, render, rerank, sources_syntax, usage, vector_cache
from ctxspark.plans import by_repo, pipeline
from ctxspark.schema import ChunkOptions
from ctxspark.sources.tables import Tables, documents_as_files, latest_chunks
from ctxspark.streaming.usage_stream import drained, log_stream, windowed_usage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Fixed parameters of the registered queries.
SMALL = ChunkOptions(whole_file_lines=20, window_lines=20, overlap_lines=5)
RULES = ["build-out/", "*.min.js", "!assets/*.min.js", "src/**/vendor_portal", "/test/*_a.py", "*-lock.json"]
TASK = "why does the outer cursor drop the last parcel of the ledger"
BUDGET = 8000


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its own name."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


CHUNKS = "chunk AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST) = 1)"
FILES = "file AS (SELECT coalesce(repo_id, 'none') AS repo_id, coalesce(lower(source), 'none') || '/' || doc_id || '.' || coalesce(lower(lang), 'none') AS path, doc_id, text, strlen(text) AS size FROM documents WHERE text IS NOT NULL)"
JS_SQL = r"""(?:from|require\(|import\()\s*[''"]([^''"]+)[''"]"""
LINES = "CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, -2) ELSE string_split(text, chr(10)) END"
EXT = r"regexp_extract(lower(path), '(\.[^./]*)$', 1)"
CUT = (
    f"l AS (SELECT *, {LINES} AS ls FROM file), n AS (SELECT *, len(ls) AS n FROM l), "
    "w AS (SELECT doc_id, repo_id, path, 0 AS seq, 1 AS start_line, n AS end_line, text AS chunk_text, true AS is_whole_file FROM n WHERE n <= 20 UNION ALL "
    "SELECT doc_id, repo_id, path, i, i * 15 + 1, least(i * 15 + 20, n), array_to_string(list_slice(ls, i * 15 + 1, least(i * 15 + 20, n)), chr(10)), false "
    "FROM (SELECT *, unnest(range(0, CAST(ceil((n - 20) / 15.0) AS BIGINT) + 1)) AS i FROM n WHERE n > 20))")  # fmt: skip
WORDS = f"list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w <> '' AND w NOT IN ({_list(STOP_WORDS)}))"
FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(regexp_extract_all(word, '.'), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
TERMS = (
    f"t AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents WHERE text IS NOT NULL), "
    "tf AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY ALL), "
    f"h AS (SELECT word, {FNV} AS u FROM (SELECT DISTINCT word FROM tf)), "
    "b AS (SELECT word, (CASE WHEN u >= 2147483648 THEN 4294967296 - u ELSE u END) % 1024 AS bucket FROM h), "
    "c AS (SELECT doc_id, bucket, sum(n) AS n FROM tf JOIN b USING (word) GROUP BY ALL)")  # fmt: skip
ENTRY = "entry AS (SELECT * FROM cache_entries WHERE cache_version = 2 AND vector IS NOT NULL AND entry_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY provider_ns, entry_key ORDER BY saved_at DESC NULLS LAST, repo_id DESC NULLS LAST) = 1)"
EDGES = "edge AS (SELECT DISTINCT repo_id, src, dst FROM (SELECT repo_id, src, dst FROM import_edges UNION ALL SELECT repo_id, dst, src FROM import_edges) WHERE src <> dst)"
SCORED = f"{CHUNKS}, scored AS (SELECT DISTINCT s.query_id, s.chunk_id, s.score, s.semantic_score, s.structural_bonus, s.llm_reason, s.pinned, c.repo_id, c.path, c.seq, c.start_line, c.end_line, c.text, c.is_whole_file FROM scored_chunks s JOIN chunk c USING (chunk_id))"
RANKED = "usable AS (SELECT * FROM scored WHERE score IS NOT NULL AND NOT isnan(score)), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo_id, path, seq, chunk_id) AS rank FROM usable)"
PRICED = f"{SCORED}, {RANKED}, priced AS (SELECT *, coalesce(CAST(ceil(length(text) / 4.0) AS BIGINT), 0) AS tokens FROM ranked), fits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM priced WHERE tokens <= {BUDGET})"
FOLD = f"fold AS (SELECT query_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, false AS took FROM (SELECT DISTINCT query_id FROM fits) UNION ALL SELECT f.query_id, f.rn, CASE WHEN fold.used + f.tokens <= {BUDGET} THEN fold.used + f.tokens ELSE fold.used END, fold.used + f.tokens <= {BUDGET} FROM fold JOIN fits f ON f.query_id = fold.query_id AND f.rn = fold.rn + 1)"


PLACE = ["repo_id", "path", "seq", "start_line", "end_line", "is_whole_file"]


def scored(t: Tables, extra: dict | None = None) -> DataFrame:
    """The distinct scored chunks with their chunk's place and text, or instead of the text what ``extra`` makes of it."""
    rows = t.scored_chunks.select("query_id", "chunk_id", "score", "semantic_score", "structural_bonus", "llm_reason", "pinned").distinct()
    made = {"text": F.col("text")} if extra is None else extra
    chunks = latest_chunks(t.chunks.withColumns({f"_{k}": v for k, v in made.items()}), [*PLACE, *[f"_{k}" for k in made]])
    return rows.join(chunks.withColumnsRenamed({f"_{k}": k for k in made}), "chunk_id")


def picked(t: Tables, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """All ranked chunks with tokens, and those that the budget takes."""
    order = [("score", "desc"), ("repo_id", "asc"), ("path", "asc"), ("seq", "asc"), ("chunk_id", "asc")]
    made = {"tokens": surrogate_tokens(F.col("text"))} | ({"text": F.col("text")} if texts else {})
    priced = scored(t, made).filter("score IS NOT NULL AND NOT isnan(score)").withColumn("budget", F.lit(BUDGET))
    narrow = priced.select("query_id", "chunk_id", "tokens", "budget", *[c for c, _ in order[:-1]])
    return priced, budget.selected(narrow, ["query_id"], ["chunk_id"], order)


# --- scans, filters, projections ---


@query(f"WITH {CHUNKS} SELECT chunk_id, path, strlen(text) AS size FROM chunk WHERE strlen(text) BETWEEN 1 AND 524288 AND {EXT} NOT IN ({_list(BINARY_EXTENSIONS)}) AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', '.DS_Store']) AND NOT contains(text, chr(0))")
def candidate_filter(t: Tables) -> DataFrame:
    sized = t.chunks.withColumns({"size": F.octet_length("text").cast("bigint"), "plain": filters.looks_textual(F.col("text").cast("binary"))})
    c = latest_chunks(sized, ["path", "size", "plain"])
    return c.filter(filters.admitted(F.col("path"), F.col("size")) & F.col("plain")).select("chunk_id", "path", "size")


@query(r"""SELECT DISTINCT repo_id, path FROM chunks WHERE path IS NOT NULL AND NOT (CASE
 WHEN regexp_matches(path, '(?i)(^|/)[^/]*-lock\.json(/|$)') THEN true WHEN regexp_matches(path, '(?i)^test/[^/]*_a\.py(/|$)') THEN true
 WHEN regexp_matches(path, '(?i)^src/(.*/)?vendor_portal(/|$)') THEN true WHEN regexp_matches(path, '(?i)^assets/[^/]*\.min\.js(/|$)') THEN false
 WHEN regexp_matches(path, '(?i)(^|/)[^/]*\.min\.js(/|$)') THEN true WHEN regexp_matches(path, '(?i)(^|/)build-out/') THEN true ELSE false END)""")
def ignore_rules(t: Tables) -> DataFrame:
    return t.chunks.select("repo_id", "path").distinct().filter(F.col("path").isNotNull() & ~filters.ignored(F.col("path"), RULES))


@query(f"SELECT {EXT} AS ext, coalesce(map_extract(MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in FENCE_LANGUAGES.items())}}}, {EXT})[1], '') AS fence, count(*) AS n FROM chunks GROUP BY ALL")
def ext_of_path(t: Tables) -> DataFrame:
    return t.chunks.groupBy(extension(F.col("path")).alias("ext"), fence_language(F.col("path")).alias("fence")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM scored_chunks WHERE pinned AND chunk_id IS NOT NULL)")
def pin_exclude(t: Tables) -> DataFrame:
    return filters.without_pins(t.chunks.select("chunk_id").filter("chunk_id IS NOT NULL").distinct(), t.scored_chunks.filter("pinned"), ["chunk_id"])


@query("SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM scored_chunks WHERE pinned)")
def pin_only(t: Tables) -> DataFrame:
    return filters.only_pins(t.chunks.select("chunk_id").distinct(), t.scored_chunks.filter("pinned"), ["chunk_id"])


# --- chunking ---


@query(f"WITH {FILES} SELECT doc_id, len({LINES}) AS n_lines FROM file")
def line_counts(t: Tables) -> DataFrame:
    return documents_as_files(t.documents).select("doc_id", F.size(lines_of(F.col("text"))).cast("bigint").alias("n_lines"))


@query(f"WITH {FILES} SELECT doc_id, unnest(range(1, len({LINES}) + 1)) AS line_no, unnest({LINES}) AS line FROM file")
def lines_exploded(t: Tables) -> DataFrame:
    lines = chunking.exploded_lines(documents_as_files(t.documents).select("doc_id", "text"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query(f"WITH {FILES}, {CUT} SELECT doc_id, start_line, end_line, chunk_text FROM w WHERE is_whole_file")
def whole_file_chunks(t: Tables) -> DataFrame:
    return chunking.chunked(documents_as_files(t.documents), SMALL).filter("is_whole_file").select("doc_id", "start_line", "end_line", "chunk_text")


@query(f"WITH {FILES}, {CUT} SELECT doc_id, seq, start_line, end_line, chunk_text FROM w WHERE NOT is_whole_file")
def line_windows(t: Tables) -> DataFrame:
    return chunking.chunked(documents_as_files(t.documents), SMALL).filter("NOT is_whole_file").select("doc_id", "seq", "start_line", "end_line", "chunk_text")


@query(rf"WITH {FILES}, {CUT}, f AS (SELECT *, regexp_matches(chunk_text, '[^\s\x{{FEFF}}]') AS full_, count(*) OVER p AS n, sum(CASE WHEN regexp_matches(chunk_text, '[^\s\x{{FEFF}}]') THEN 1 ELSE 0 END) OVER p AS nf FROM w WINDOW p AS (PARTITION BY path, repo_id)) SELECT doc_id, seq, start_line, end_line, is_whole_file FROM f WHERE n <= 1 OR full_ OR nf = 0")
def all_chunks(t: Tables) -> DataFrame:
    chunks = chunking.chunked(documents_as_files(t.documents), SMALL)
    return chunking.without_blank(chunks, ["repo_id", "path"], "chunk_text").select("doc_id", "seq", "start_line", "end_line", "is_whole_file")


@query(f"WITH {CHUNKS} SELECT chunk_id, start_line - coalesce(max(end_line) OVER (PARTITION BY repo_id, path ORDER BY start_line, end_line, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS gap FROM chunk WHERE end_line IS NOT NULL")
def chunk_gaps(t: Tables) -> DataFrame:
    return chunking.line_gaps(latest_chunks(t.chunks, ["repo_id", "path", "start_line", "end_line"]).filter("end_line IS NOT NULL"), ["repo_id", "path"]).select("chunk_id", "gap")


@query(f"WITH RECURSIVE {CHUNKS}, s AS (SELECT repo_id, path, start_line AS s, end_line AS e, row_number() OVER (PARTITION BY repo_id, path ORDER BY start_line, end_line, chunk_id) AS rn FROM chunk WHERE end_line IS NOT NULL), p AS (SELECT repo_id, path, rn, s, e, 1 AS pack FROM s WHERE rn = 1 UNION ALL SELECT s.repo_id, s.path, s.rn, CASE WHEN s.e - p.s + 1 <= 240 THEN p.s ELSE s.s END, s.e, CASE WHEN s.e - p.s + 1 <= 240 THEN p.pack ELSE p.pack + 1 END FROM p JOIN s ON s.repo_id = p.repo_id AND s.path = p.path AND s.rn = p.rn + 1) SELECT repo_id, path, max(s) AS first_line, arg_max(e, rn) AS last_line FROM p GROUP BY repo_id, path, pack")
def segment_pack(t: Tables) -> DataFrame:
    seg = F.struct(F.col("start_line").alias("s"), F.col("end_line").alias("e"), "chunk_id")
    files = latest_chunks(t.chunks, ["repo_id", "path", "start_line", "end_line"]).filter("end_line IS NOT NULL AND repo_id IS NOT NULL AND path IS NOT NULL").groupBy("repo_id", "path").agg(F.array_sort(F.collect_list(seg)).alias("g"))
    plain = F.transform("g", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return files.select("repo_id", "path", F.explode(chunking.packed_segments(plain, 240)).alias("p")).select("repo_id", "path", F.col("p.s").alias("first_line"), F.col("p.e").alias("last_line"))


@query(f"WITH {CHUNKS}, l AS (SELECT * FROM chunk WHERE text IS NOT NULL) SELECT chunk_id, 0 AS piece, text FROM l WHERE ceil(length(text) / 4.0) <= 1000 UNION ALL SELECT chunk_id, i, substring(text, i * 4000 + 1, 4000) FROM (SELECT *, CAST(unnest(range(0, CAST(ceil(length(text) / 4000.0) AS BIGINT))) AS INT) AS i FROM l WHERE ceil(length(text) / 4.0) > 1000)")
def token_cap(t: Tables) -> DataFrame:
    chunks = latest_chunks(t.chunks).filter("text IS NOT NULL").select("chunk_id", "text")
    return chunking.token_capped(chunks, chunking.even_pieces(F.col("text"), 4000), surrogate_tokens(F.col("text")), 1000).select("chunk_id", "piece", "text")


@query()
def bpe_token_cap(t: Tables) -> DataFrame:
    chunks = latest_chunks(t.chunks).filter("text IS NOT NULL").select("chunk_id", "text")
    pieces = chunking.token_capped(chunks, token_slicer(2000)(F.col("text")), F.length("text"), 2000)
    return pieces.withColumn("tokens", token_counter()(F.col("text"))).select("chunk_id", "piece", "tokens", "text")


@query()
def bpe_tokens(t: Tables) -> DataFrame:
    return documents_as_files(t.documents).select("doc_id", token_counter()(F.col("text")).alias("tokens"))


@query()
def syntax_chunks(t: Tables) -> DataFrame:
    files = chunking.assembled_files(latest_chunks(t.chunks), ["repo_id", "path"])
    return sources_syntax.syntax_chunks(files)


@query()
def syntax_imports(t: Tables) -> DataFrame:
    return sources_syntax.syntax_imports(chunking.assembled_files(latest_chunks(t.chunks), ["repo_id", "path"]))


# --- embedding, similarity, cache ---


@query(f"WITH {TERMS} SELECT doc_id, word, n FROM tf")
def fake_terms(t: Tables) -> DataFrame:
    return embedding.terms(t.documents.filter("text IS NOT NULL"), ["doc_id"])


@query(f"WITH {TERMS} SELECT word, bucket FROM b")
def fake_buckets(t: Tables) -> DataFrame:
    words = embedding.terms(t.documents, ["doc_id"]).select("word").distinct()
    return words.select("word", bucket_of(F.col("word")).cast("bigint").alias("bucket"))


@query(f"WITH {TERMS}, m AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL) SELECT doc_id, bucket, round(n / norm, 6) AS weight FROM c JOIN m USING (doc_id)")
def fake_embed(t: Tables) -> DataFrame:
    v = embedding.sparse_vectors(t.documents, ["doc_id"])
    return v.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 6).alias("weight"))


@query(f"WITH {TERMS}, q0 AS (SELECT unnest(list_filter(regexp_split_to_array('{TASK}', '[^a-z0-9_]+'), lambda w: w <> '' AND w NOT IN ({_list(STOP_WORDS)}))) AS word), q1 AS (SELECT word, {FNV} AS u FROM q0), q2 AS (SELECT (CASE WHEN u >= 2147483648 THEN 4294967296 - u ELSE u END) % 1024 AS bucket, count(*) AS n FROM q1 GROUP BY 1), q AS (SELECT bucket, n / (SELECT sqrt(sum(n * n)) FROM q2) AS w FROM q2), s AS (SELECT doc_id, sum(c.n * coalesce(w, 0)) / sqrt(sum(c.n * c.n)) AS score FROM c LEFT JOIN q USING (bucket) GROUP BY ALL) SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM documents LEFT JOIN s USING (doc_id) ORDER BY coalesce(score, 0) DESC, doc_id LIMIT 100")
def semantic_topk(t: Tables) -> DataFrame:
    s = embedding.scored_by_words(t.documents, ["doc_id"], TASK)
    return s.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(100).select("doc_id", F.round("score", 6).alias("score"))


@query("WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) DESC, vec_id LIMIT 20")
def vector_topk(t: Tables) -> DataFrame:
    q = t.embeddings.orderBy("vec_id").select("embedding").first()["embedding"]
    s = t.embeddings.withColumn("s", embedding.cosine_with(list(q))("embedding"))
    return s.orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", F.round("s", 6).alias("score"))


@query("WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT label, round(max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[]))), 6) AS best, count(*) AS n FROM embeddings, q GROUP BY label")
def vector_by_label(t: Tables) -> DataFrame:
    q = t.embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").cast("array<double>").alias("e"))
    s = t.embeddings.join(F.broadcast(q)).withColumn("s", embedding.cosine(F.col("embedding").cast("array<double>"), F.col("e")))
    return s.groupBy("label").agg(F.round(F.max("s"), 6).alias("best"), F.count("*").alias("n"))


@query(f"WITH {CHUNKS} SELECT chunk_id, sha256('fake' || chr(0) || text) AS entry_key FROM chunk")
def cache_keys(t: Tables) -> DataFrame:
    keyed = t.chunks.withColumn("entry_key", vector_cache.cache_key(F.lit("fake"), F.col("text")))
    return latest_chunks(keyed, ["entry_key"])


@query(f"WITH {CHUNKS}, {ENTRY} SELECT chunk_id, e.entry_key IS NOT NULL AS hit, coalesce(len(e.vector), 0) AS dims FROM chunk c LEFT JOIN entry e ON e.provider_ns = 'openai:text-small-mock' AND e.entry_key = sha256('openai:text-small-mock' || chr(0) || c.text)")
def cache_hits(t: Tables) -> DataFrame:
    found = vector_cache.looked_up(latest_chunks(t.chunks), vector_cache.live_entries(t.cache_entries), "openai:text-small-mock")
    return found.select("chunk_id", F.col("vector").isNotNull().alias("hit"), F.coalesce(F.size("vector"), F.lit(0)).cast("bigint").alias("dims"))


@query(f"WITH {CHUNKS}, {ENTRY} SELECT DISTINCT sha256('voyage:code-mock' || chr(0) || text) AS entry_key FROM chunk WHERE text IS NOT NULL AND sha256('voyage:code-mock' || chr(0) || text) NOT IN (SELECT entry_key FROM entry WHERE provider_ns = 'voyage:code-mock')")
def cache_misses(t: Tables) -> DataFrame:
    return vector_cache.misses(latest_chunks(t.chunks), vector_cache.live_entries(t.cache_entries), "voyage:code-mock").select("entry_key")


@query(f"WITH {ENTRY} SELECT provider_ns, count(*) AS entries FROM entry GROUP BY 1")
def cache_size(t: Tables) -> DataFrame:
    return vector_cache.live_entries(t.cache_entries).groupBy("provider_ns").agg(F.count("*").alias("entries"))


# --- import graph ---


@query(f"WITH {EDGES} SELECT * FROM edge")
def import_graph(t: Tables) -> DataFrame:
    return graph.undirected(t.import_edges, ["repo_id"])


@query(f"WITH {EDGES} SELECT repo_id, src AS path, count(*) AS degree FROM edge GROUP BY 1, 2")
def graph_degree(t: Tables) -> DataFrame:
    return graph.degrees(t.import_edges, ["repo_id"])


@query(rf"WITH {CHUNKS}, x AS (SELECT chunk_id, unnest(regexp_extract_all(text, '{JS_SQL}', 1)) AS spec FROM chunk WHERE {EXT} IN ('.ts', '.js', '.mjs', '.cjs') UNION ALL SELECT chunk_id, translate(regexp_extract(m, '(?:from|import)\s+([.\w]+)', 1), '.', '/') FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '(?m)^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))')) AS m FROM chunk WHERE {EXT} = '.py')) SELECT DISTINCT chunk_id, spec FROM x")
def links_extract(t: Tables) -> DataFrame:
    return graph.extracted_imports(latest_chunks(t.chunks).filter("text IS NOT NULL"), ["chunk_id"])


def _imports(t: Tables) -> DataFrame:
    """Imports of each file by pattern, with the repository's aliases (``@/`` for ``src/``)."""
    chunks = latest_chunks(t.chunks).filter("text IS NOT NULL")
    specs = graph.extracted_imports(chunks, ["repo_id", "path"]).distinct()
    alias = t.repos.select("repo_id", F.lit("@/").alias("prefix"), F.lit("").alias("suffix"), F.lit("src/*").alias("target"), F.lit(".").alias("base_url"), F.lit(1).alias("ord")).distinct()
    return graph.with_aliases(specs, alias, ["repo_id"])


@query(rf"WITH {CHUNKS}, x AS (SELECT DISTINCT repo_id, path, unnest(regexp_extract_all(text, '{JS_SQL}', 1)) AS spec FROM chunk WHERE {EXT} IN ('.ts', '.js', '.mjs', '.cjs')) SELECT DISTINCT repo_id, path, spec, 'src/' || substring(spec, 3) AS base FROM x WHERE spec LIKE '@/%' AND repo_id IN (SELECT repo_id FROM repos)")
def alias_expand(t: Tables) -> DataFrame:
    return _imports(t).filter("ord > 0").select("repo_id", "path", "spec", "base")


@query()
def resolve_imports(t: Tables) -> DataFrame:
    return graph.resolved_imports(_imports(t), t.chunks.select("repo_id", "path"), ["repo_id"])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT repo_id, src, dst FROM (SELECT repo_id, src, dst FROM import_edges WHERE edge_kind = 'reexport' UNION ALL SELECT repo_id, dst, src FROM import_edges WHERE edge_kind = 'reexport') WHERE src <> dst),
 reach AS (SELECT repo_id, src AS path, src AS other FROM e UNION SELECT r.repo_id, r.path, e.dst FROM reach r JOIN e ON e.repo_id = r.repo_id AND e.src = r.other) SELECT repo_id, path, min(other) AS root FROM reach GROUP BY 1, 2""")
def reexport_groups(t: Tables) -> DataFrame:
    return graph.components(t.import_edges.filter("edge_kind = 'reexport'"), ["repo_id"])


@query()
def barrel_closure(t: Tables) -> DataFrame:
    specs = syntax_imports(t).filter("reexport").withColumn("ord", F.lit(0)).withColumn("base", graph.import_bases(F.col("spec"), F.col("path")))
    direct = graph.resolved_imports(specs, t.chunks.select("repo_id", "path"), ["repo_id"]).select("repo_id", F.col("path").alias("src"), "dst")
    return graph.reexport_closure(direct, ["repo_id"])


# --- ranking, rerank, budget, output ---


@query(f"WITH {SCORED} SELECT query_id, repo_id, path, round(max(semantic_score), 6) AS best FROM scored WHERE semantic_score IS NOT NULL AND NOT isnan(semantic_score) GROUP BY ALL")
def best_per_file(t: Tables) -> DataFrame:
    return ranking.best_per_file(scored(t, {})).withColumn("best", F.round("best", 6))


SEEDS = "best AS (SELECT query_id, repo_id, path, max(semantic_score) AS best FROM scored WHERE semantic_score IS NOT NULL AND NOT isnan(semantic_score) GROUP BY ALL), seed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, repo_id, path) AS seed_rank FROM best QUALIFY seed_rank <= 3)"


@query(f"WITH {SCORED}, {SEEDS} SELECT query_id, repo_id, path, CAST(seed_rank AS INT) AS seed_rank FROM seed")
def seed_files(t: Tables) -> DataFrame:
    return ranking.seed_files(scored(t, {})).select("query_id", "repo_id", "path", "seed_rank")


@query(f"WITH {SCORED}, {SEEDS}, {EDGES}, near AS (SELECT DISTINCT s.query_id, s.repo_id, e.dst AS path, s.seed_rank, s.path AS seed FROM seed s JOIN edge e ON e.repo_id = s.repo_id AND e.src = s.path), linked AS (SELECT query_id, repo_id, path, string_agg(seed, ',' ORDER BY seed_rank) AS connected FROM near GROUP BY 1, 2, 3) SELECT query_id, chunk_id, coalesce(connected, '') AS connected, round(semantic_score + CASE WHEN connected IS NULL THEN 0 ELSE 0.05 END, 6) AS final_score FROM scored LEFT JOIN linked USING (query_id, repo_id, path)")
def structural_bonus(t: Tables) -> DataFrame:
    b = ranking.structural_bonus(scored(t, {}), graph.undirected(t.import_edges, ["repo_id"]))
    return b.select("query_id", "chunk_id", F.array_join("connected", ",").alias("connected"), F.round("final_score", 6).alias("final_score"))


@query(f"WITH {SCORED}, {RANKED} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 20")
def final_rank(t: Tables) -> DataFrame:
    return ranking.ranked(scored(t, {}), "score", 20).select("query_id", "chunk_id", "rank")


def _keywords_sql(text: str) -> str:
    tokens = f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[^A-Za-z0-9_]+'), lambda w: w <> '')"
    parts = f"flatten(list_transform({tokens}, lambda w: list_concat([lower(w)], string_split(lower(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' '))))"
    return f"list_filter({parts}, lambda w: w NOT IN ({_list(KEYWORD_STOP_WORDS)}))"


@query(f"SELECT doc_id, coalesce((SELECT string_agg(DISTINCT u, ' ' ORDER BY u) FROM unnest({_keywords_sql('text')}) x(u)), '') AS words FROM documents")
def keywords(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(F.array_sort(keywords_of(F.col("text"))), " ").alias("words"))


@query(f"SELECT doc_id, list_has_any({_keywords_sql('text')}, {_keywords_sql(repr(TASK))}) AS keep FROM documents")
def keyword_overlap(t: Tables) -> DataFrame:
    judged = rerank.keyword_verdicts(t.documents.select("doc_id", "text", F.lit(TASK).alias("task")))
    return judged.select("doc_id", "keep")


@query(f"WITH {SCORED}, {RANKED}, v AS (SELECT *, rank > 20 OR list_has_any({_keywords_sql('text')}, {_keywords_sql(repr(TASK))}) AS own FROM ranked), l AS (SELECT query_id, path || ':' || start_line || '-' || end_line AS id, arg_max(own, rank) AS own FROM v WHERE rank <= 20 GROUP BY 1, 2) SELECT v.query_id, v.chunk_id, v.rank > 20 OR coalesce(l.own, true) AS kept FROM v LEFT JOIN l ON l.query_id = v.query_id AND l.id = v.path || ':' || v.start_line || '-' || v.end_line")
def apply_rerank(t: Tables) -> DataFrame:
    ids = scored(t).filter("score IS NOT NULL AND NOT isnan(score)").withColumn("task", F.lit(TASK)).withColumn(
        "id", F.when(F.col("end_line").isNotNull(), candidate_id(F.col("path"), F.col("start_line"), F.col("end_line"))))
    top = ranking.ranked(ids, "score", rerank.DEFAULT_TOP)
    verdicts = rerank.keyword_verdicts(top.filter("id IS NOT NULL")).withColumn("ord", F.col("rank"))
    beyond = ids.join(top.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left").fillna(rerank.DEFAULT_TOP + 1, ["rank"])
    return rerank.with_verdicts(beyond, verdicts).select("query_id", "chunk_id", "kept")


@query(f"WITH RECURSIVE {PRICED}, {FOLD} SELECT fits.query_id, chunk_id, tokens, used AS cum_tokens FROM fold JOIN fits USING (query_id, rn) WHERE took")
def budget_select(t: Tables) -> DataFrame:
    return picked(t)[1]


@query(f"WITH {SCORED}, p AS (SELECT query_id, sum(coalesce(CAST(ceil(length(text) / 4.0) AS BIGINT), 0)) AS used FROM scored WHERE pinned GROUP BY 1) SELECT query_id, CAST(greatest({BUDGET} - coalesce(used, 0), 0) AS BIGINT) AS budget FROM (SELECT DISTINCT query_id FROM scored_chunks) LEFT JOIN p USING (query_id)")
def pinned_budget(t: Tables) -> DataFrame:
    pins = scored(t, {"tokens": surrogate_tokens(F.col("text"))}).filter("pinned")
    all_queries = t.scored_chunks.select("query_id").distinct().withColumn("budget", F.lit(BUDGET))
    return budget.after_pins(pins, all_queries, ["query_id"]).select("query_id", F.col("budget").cast("bigint").alias("budget"))


@query(f"WITH RECURSIVE {PRICED}, {FOLD}, a AS (SELECT query_id, sum(tokens) AS taken FROM fold JOIN fits USING (query_id, rn) WHERE took GROUP BY 1), b AS (SELECT query_id, sum(tokens) AS all_tokens FROM priced GROUP BY 1) SELECT query_id, CAST(all_tokens AS BIGINT) AS all_tokens, CAST(coalesce(taken, 0) AS BIGINT) AS taken, round(1 - coalesce(taken, 0) / all_tokens, 6) AS saved FROM b LEFT JOIN a USING (query_id) WHERE all_tokens > 0")
def token_savings(t: Tables) -> DataFrame:
    priced, taken = picked(t)
    sums = taken.groupBy("query_id").agg(F.sum("tokens").alias("taken"))
    total = priced.groupBy("query_id").agg(F.sum("tokens").alias("all_tokens")).filter("all_tokens > 0")
    return total.join(sums, "query_id", "left").fillna(0, ["taken"]).withColumn("saved", F.round(1 - F.col("taken") / F.col("all_tokens"), 6))


LINKED = "linked AS (SELECT query_id, chunk_id, arg_max(connected_to, list_transform(connected_to, lambda x: coalesce(x, ''))) AS connected_to FROM scored_chunks WHERE connected_to IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {SCORED}, {LINKED} SELECT query_id, chunk_id, CASE WHEN pinned THEN 'pinned (always included)' ELSE 'score ' || printf('%.3f', round(score, 3)) || ' (' || CASE WHEN structural_bonus > 0 THEN 'semantic ' || printf('%.3f', round(semantic_score, 3)) || ' + connected to ' || array_to_string(list_transform(connected_to, lambda x: '`' || x || '`'), ', ') ELSE 'semantic match' END || CASE WHEN llm_reason <> '' THEN '; relevance check: ' || llm_reason ELSE '' END || ')' END AS why FROM scored LEFT JOIN linked USING (query_id, chunk_id) WHERE score IS NOT NULL AND NOT isnan(score)")
def explain_why(t: Tables) -> DataFrame:
    rows = scored(t, {}).filter("score IS NOT NULL AND NOT isnan(score)").join(_links(t), ["query_id", "chunk_id"], "left")
    return rows.select("query_id", "chunk_id", render.why().alias("why"))


def _links(t: Tables) -> DataFrame:
    """The links of each scored chunk; of several lists the greatest."""
    return t.scored_chunks.filter("connected_to IS NOT NULL").groupBy("query_id", "chunk_id").agg(F.max("connected_to").alias("connected_to"))


@query(f"WITH {CHUNKS}, c AS (SELECT repo_id, path, start_line, coalesce(seq, -1) AS seq, chunk_id, (CASE WHEN coalesce(is_whole_file, false) THEN '' ELSE '_lines ' || start_line || '-' || end_line || '_' || chr(10) || chr(10) END) || '```' || coalesce(map_extract(MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in FENCE_LANGUAGES.items())}}}, {EXT})[1], '') || chr(10) || text || chr(10) || '```' || chr(10) AS b FROM chunk WHERE text IS NOT NULL AND end_line IS NOT NULL) SELECT repo_id, path, string_agg(b, chr(10) ORDER BY start_line, seq, chunk_id) AS content FROM c GROUP BY 1, 2")
def content_by_file(t: Tables) -> DataFrame:
    return render.content_by_file(latest_chunks(t.chunks).filter("text IS NOT NULL AND end_line IS NOT NULL"), ["repo_id"])


@query()
def context_bundles(t: Tables) -> DataFrame:
    """Bundles of the given scores: the stages from the budget on."""
    priced, taken = picked(t, True)
    chosen = priced.dropDuplicates(["query_id", "chunk_id"]).drop("tokens").join(taken, ["query_id", "chunk_id"]).join(_links(t), ["query_id", "chunk_id"], "left").withColumn("rank", F.col("cum_tokens"))
    sums = chosen.groupBy("query_id").agg(F.sum("tokens").alias("tokens_used"), F.count("*").alias("n_selected"))
    totals = priced.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("repo_id").alias("repo")).join(sums, "query_id", "left").fillna(0, ["tokens_used", "n_selected"])
    totals = totals.select("query_id", F.lit(TASK).alias("task"), "repo", F.lit(BUDGET).alias("budget"), "tokens_used", "n_selected", (F.col("_n") - F.col("n_selected")).alias("n_skipped"))
    return render.bundles(chosen, totals, ["query_id"], render.exact_fixed, "UNICODE")


@query()
def compiled_context(t: Tables) -> DataFrame:
    """The whole pipeline: the tasks of the usage log against the files of their repositories, with the pinned chunks' files pinned.

    A task without a budget has the default one; a task without a repository sees all.
    """
    tasks = usage.latest_entries(t.run_metrics).filter("entry_type = 'run' AND task IS NOT NULL").groupBy("repo_id", "task").agg(
        F.min("entry_id").alias("query_id"), F.coalesce(F.max("budget_tokens"), F.lit(BUDGET)).alias("budget"))
    pins = t.scored_chunks.filter("pinned").select("chunk_id").distinct().join(latest_chunks(t.chunks, ["repo_id", "path"]), "chunk_id").select("repo_id", "path").distinct()
    files = chunking.file_parts(latest_chunks(t.chunks, ["repo_id", "path", "start_line", "end_line", "text"]), ["repo_id", "path"])
    closure = graph.reexport_closure(t.import_edges.filter("edge_kind = 'reexport'"), ["repo_id"])
    return by_repo.compiled_by_repo(files, tasks, graph.with_barrels(t.import_edges, closure, ["repo_id"]), pins=pins)


# --- usage log ---

LOG = "log AS (SELECT * FROM run_metrics WHERE entry_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY received_at DESC NULLS LAST, logged_at DESC NULLS LAST) = 1)"
SUMS = "count(*) FILTER (entry_type = 'run') AS runs, round(avg(tokens_used) FILTER (entry_type = 'run'), 6) AS avg_tokens_used, round(avg(budget_tokens) FILTER (entry_type = 'run'), 6) AS avg_budget_tokens, count(*) FILTER (entry_type = 'feedback' AND lower(trim(outcome)) = 'hit') AS hits, count(*) FILTER (entry_type = 'feedback' AND lower(trim(outcome)) = 'miss') AS misses, round(count(*) FILTER (entry_type = 'feedback' AND lower(trim(outcome)) = 'hit') / nullif(count(*) FILTER (entry_type = 'feedback' AND lower(trim(outcome)) IN ('hit', 'miss')), 0), 6) AS hit_rate"


@query(f"WITH {LOG} SELECT {SUMS} FROM log")
def metrics_summary(t: Tables) -> DataFrame:
    return usage.summary(usage.latest_entries(t.run_metrics))


@query(f"WITH {LOG} SELECT repo_id, {SUMS} FROM log GROUP BY repo_id")
def metrics_by_repo(t: Tables) -> DataFrame:
    return usage.summary(usage.latest_entries(t.run_metrics), ["repo_id"])


@query(f"WITH {LOG} SELECT strftime(logged_at, '%Y-%m-%d') AS day, {SUMS} FROM log GROUP BY 1")
def metrics_by_day(t: Tables) -> DataFrame:
    days = usage.latest_entries(t.run_metrics).withColumn("day", F.date_format("logged_at", "yyyy-MM-dd"))
    return usage.summary(days, ["day"])


@query("""WITH one AS (SELECT * FROM run_metrics WHERE entry_id IS NOT NULL AND logged_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY logged_at) = 1)
 SELECT strftime(logged_at, '%Y-%m-%d') AS day, count(*) FILTER (entry_type = 'run') AS runs, count(*) FILTER (entry_type = 'feedback' AND lower(trim(outcome)) = 'hit') AS hits, count(*) FILTER (entry_type = 'feedback' AND lower(trim(outcome)) = 'miss') AS misses FROM one GROUP BY 1""")
def metrics_stream(t: Tables) -> DataFrame:
    stream = log_stream(t.spark, f"{t.folder}/run_metrics.parque*", t.run_metrics.schema)
    return drained(windowed_usage(stream)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"WITH {CHUNKS} SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS chunks, max(n) AS most_chunks, max(lines) AS most_lines FROM (SELECT count(*) AS n, max(end_line) AS lines FROM chunk GROUP BY repo_id, path)")
def stress_totals(t: Tables) -> DataFrame:
    return pipeline.coverage(latest_chunks(t.chunks, ["repo_id", "path", "end_line"]))
