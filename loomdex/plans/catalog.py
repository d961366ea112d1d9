"""The catalogue: each query's Spark plan and its SQL for DuckDB, formulated independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.config import ChunkConfig, EngineConfig
from loomdex.functions import hashing, paths, requests, text
from loomdex.functions.vectors import is_zero
from loomdex.operators import cache, hash_only, merkle, models, sync, vector_index
from loomdex.operators.chunking import ast_chunks as syntax
from loomdex.operators.chunking import context, gaps, lines
from loomdex.operators.ranking import with_positions
from loomdex.plans import adapters as on
from loomdex.runtime import materialize, ship
from loomdex.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2024-01-30 00:00:00"
WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
FILES = """files AS (
  SELECT source AS project_id, source || '/' || lpad(doc_id::VARCHAR, 12, '0') || '.txt' AS relative_path, text AS content, doc_id
  FROM documents)"""


def windows_sql(size: int, step: int, files: str = "files", name: str = "chunks", least: int = 100) -> str:
    return f"""{name}_l AS (SELECT *, string_split(content, chr(10)) AS l FROM {files}),
{name}_w AS (SELECT *, array_to_string(l[i + 1:i + {size}], chr(10)) AS raw FROM (
  SELECT *, unnest(range(0, len(l), {step})) AS i FROM {name}_l)),
{name} AS (
  SELECT project_id, relative_path, sha256(trim(raw, {WS})) AS hash, (i + 1)::INTEGER AS line_start,
    least(i + {size}, len(l))::INTEGER AS line_end,
    (CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(l[1:i], chr(10))) + 1 END)::INTEGER AS char_start,
    (CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(l[1:i], chr(10))) + 1 END + length(raw))::INTEGER AS char_end,
    length(trim(raw, {WS}))::INTEGER AS char_count, trim(raw, {WS}) AS code, raw
  FROM {name}_w WHERE length(trim(raw, {WS})) >= {least})"""


SMALL = windows_sql(8, 6)
CACHED = f"""{windows_sql(8, 6, "(SELECT * FROM files WHERE doc_id % 2 = 0)", "even")},
cached AS (
  SELECT hash, max(TIMESTAMP '2024-01-01' + to_days((regexp_extract(relative_path, '(\\d+)\\.txt$', 1)::BIGINT % 60)::INTEGER)) AS expires_at
  FROM even GROUP BY hash)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Files and paths ------------------------------------------------------------------------------------


@query(f"WITH {FILES} SELECT project_id, relative_path, sha256(relative_path || content) AS hash FROM files")
def file_hash(spark, d):
    return merkle.leaves(on.files(spark, d))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(p, '\', '/') ELSE p END AS relative_path,
 '/work/tree/' || p AS absolute_path
FROM (SELECT doc_id, source || '/' || doc_id::VARCHAR || '.txt' AS p FROM documents)""")
def relative_path(spark, d):
    docs = table(spark, d, "documents")
    p = F.concat(F.lit("/work/tree/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    seen = F.when(F.col("doc_id") % 2 == 0, F.translate(p, "/", "\\")).otherwise(p)
    rel = paths.to_relative(seen, "/work/tree")
    return docs.select("doc_id", rel.alias("relative_path"), paths.to_absolute(rel, "/work/tree").alias("absolute_path"))


NAMES = ("a.ts", "b.TSX", "c.js", "d.jsx", "e.py", "f.rs", "g.go", "h.java", "i.cpp", "j.c", "k.txt", ".env", "Makefile", "l.test.Ts")
_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


def _names(spark, d):
    docs = table(spark, d, "documents")
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES)).cast("int"))
    return docs.select("doc_id", F.concat(F.col("source"), F.lit("/"), name).alias("path"))


@query(f"""SELECT doc_id, path, CASE lower(regexp_extract(path, '[^./](\\.[^./]+)$', 1))
  WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript'
  WHEN '.py' THEN 'python' WHEN '.rs' THEN 'rust' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.cpp' THEN 'cpp'
  WHEN '.c' THEN 'c' ELSE 'text' END AS language_id
FROM (SELECT doc_id, source || '/' || {_NAMES_SQL}[(doc_id % {len(NAMES)}) + 1] AS path FROM documents)""")
def language_map(spark, d):
    return _names(spark, d).withColumn("language_id", paths.language(F.col("path")))


@query(f"""SELECT doc_id, path FROM (SELECT doc_id, source || '/' || {_NAMES_SQL}[(doc_id % {len(NAMES)}) + 1] AS path FROM documents)
WHERE regexp_matches(path, '(?i)[^./]\\.(js|ts|tsx|jsx)$')""")
def extension_filter(spark, d):
    return _names(spark, d).where(paths.has_extension(F.col("path")))


PLACES = ("node_modules/x.js", "src/node_modules/x.js", "src/a.ts", ".git/config", "dist/out.js", "build/out.js", "src/build.ts", "run.log", "src/deep/run.log", ".loomdex/state.json", "src/distance.ts")
_PLACES_SQL = "[" + ", ".join(f"'{n}'" for n in PLACES) + "]"


@query(f"""SELECT doc_id, path FROM (SELECT doc_id, {_PLACES_SQL}[(doc_id % {len(PLACES)}) + 1] AS path FROM documents)
WHERE NOT (list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), ['node_modules', '.git', 'dist', 'build', '.loomdex'])
  OR path LIKE '%.log')""")
def ignore_filter(spark, d):
    place = F.get(F.array(*map(F.lit, PLACES)), (F.col("doc_id") % len(PLACES)).cast("int"))
    return table(spark, d, "documents").select("doc_id", place.alias("path")).where(~paths.is_ignored(F.col("path")))


@query(f"""SELECT doc_id, path FROM (SELECT doc_id, {_PLACES_SQL}[(doc_id % {len(PLACES)}) + 1] AS path FROM documents)
WHERE NOT list_has_any(string_split(path, '/'), ['node_modules', '.git', 'dist', '.loomdex']) AND regexp_matches(path, '\\.(js|ts|tsx|jsx)$')""")
def scan_filter(spark, d):
    place = F.get(F.array(*map(F.lit, PLACES)), (F.col("doc_id") % len(PLACES)).cast("int"))
    found = table(spark, d, "documents").select("doc_id", place.alias("path"))
    return found.where(~paths.in_skipped_folder(F.col("path")) & paths.has_extension(F.col("path")))


KINDS = ("function_declaration", "class_definition", "method_declaration", "enum_item", "struct_item", "export_statement", "decorated_definition", "type_alias_declaration", "comment")
LANGS = ("javascript", "typescript", "python", "go", "rust", "tsx")


@query(f"""WITH r AS (SELECT doc_id, {list(KINDS)}[(doc_id % {len(KINDS)}) + 1] AS node, {list(LANGS)}[(doc_id // 9 % {len(LANGS)}) + 1] AS lang FROM documents)
SELECT doc_id, CASE WHEN node = 'function_declaration' OR node = 'decorated_definition' THEN 'function' WHEN node = 'class_definition' THEN 'class'
  WHEN node = 'method_declaration' THEN 'method' WHEN node = 'struct_item' THEN 'struct' WHEN node = 'type_alias_declaration' THEN 'type' ELSE 'block' END AS chunk_type,
  (lang IN ('javascript', 'typescript') AND node IN ('function_declaration', 'export_statement')) OR (lang = 'typescript' AND node = 'type_alias_declaration')
  OR (lang = 'python' AND node IN ('class_definition', 'decorated_definition')) OR (lang = 'go' AND node IN ('function_declaration', 'method_declaration'))
  OR (lang = 'rust' AND node IN ('enum_item', 'struct_item')) AS semantic
FROM r""")
def chunk_type_map(spark, d):
    node = F.get(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS)).cast("int"))
    lang = F.get(F.array(*map(F.lit, LANGS)), (F.floor(F.col("doc_id") / len(KINDS)) % len(LANGS)).cast("int"))
    return table(spark, d, "documents").select("doc_id", paths.chunk_type(node).alias("chunk_type"), paths.is_semantic(lang, node).alias("semantic"))


# Chunks ---------------------------------------------------------------------------------------------

_CHUNK = "project_id, relative_path, hash, 'block' AS type, CAST(NULL AS VARCHAR) AS name, 'text' AS language_id, line_start, line_end, char_start, char_end, char_count"


@query(f"WITH {FILES}, {windows_sql(50, 40)} SELECT {_CHUNK} FROM chunks")
def fallback_chunks(spark, d):
    return on.chunks(spark, d, ChunkConfig()).drop("text")


@query(f"WITH {FILES}, {SMALL} SELECT {_CHUNK} FROM chunks")
def fallback_chunks_small(spark, d):
    return on.chunks(spark, d).drop("text")


@query(f"""WITH files AS (SELECT split_part(url, '/', 3) AS project_id, url AS relative_path, html AS content FROM pages), {windows_sql(50, 40)}
SELECT {_CHUNK} FROM chunks""")
def page_chunks(spark, d):
    pages = table(spark, d, "pages")
    host = F.split_part("url", F.lit("/"), F.lit(3))
    files = pages.select(host.alias("project_id"), F.col("url").alias("relative_path"), F.col("html").alias("content"), F.lit("text").alias("language_id"))
    return lines.line_windows(files).drop("text")


@query(f"WITH {FILES}, {SMALL} SELECT project_id, relative_path, line_start, char_start, char_end, (line_end - line_start + 1)::INTEGER AS line_count FROM chunks")
def chunk_offsets(spark, d):
    return on.chunks(spark, d).select("project_id", "relative_path", "line_start", "char_start", "char_end", lines.line_count().alias("line_count"))


@query(f"""WITH {FILES}, {SMALL} SELECT project_id, relative_path, hash, line_start, sha256(raw) AS code_hash, sha256(raw) = hash AS trimmed_alike FROM chunks""")
def chunk_deref(spark, d):
    read = lines.read_chunks(on.chunks(spark, d).drop("text"), on.files(spark, d))
    code = hashing.chunk_hash(F.col("code"))
    return read.select("project_id", "relative_path", "hash", "line_start", code.alias("code_hash"), (code == F.col("hash")).alias("trimmed_alike"))


@query(f"""WITH {FILES}, {windows_sql(8, 6, least=0)} SELECT project_id, count(*) FILTER (char_count >= 100) AS kept, count(*) FILTER (char_count < 100) AS dropped
FROM chunks GROUP BY project_id""")
def chunk_min_size(spark, d):
    found = on.chunks(spark, d, ChunkConfig(lines=8, overlap=2, min_chunk=0))
    big = F.col("char_count") >= 100
    return found.groupBy("project_id").agg(F.count_if(big).alias("kept"), F.count_if(~big).alias("dropped"))


@query(f"""WITH {FILES}, l AS (SELECT *, string_split(content, chr(10)) AS l FROM files),
s AS (SELECT project_id, relative_path, l, content, (6 * k + 3)::INTEGER AS a, least(6 * k + 5, len(l))::INTEGER AS z
  FROM (SELECT *, unnest(range(0, len(l) // 6)) AS k FROM l)),
g AS (SELECT project_id, relative_path, l, lag(z, 1, 0) OVER w + 1 AS a, a - 1 AS z FROM s WINDOW w AS (PARTITION BY relative_path ORDER BY a)
  UNION ALL SELECT project_id, relative_path, any_value(l), max(z) + 1, len(any_value(l)) FROM s GROUP BY project_id, relative_path),
t AS (SELECT project_id, relative_path, a::INTEGER AS line_start, z::INTEGER AS line_end, array_to_string(l[a:z], chr(10)) AS raw,
  CASE WHEN a > 1 THEN length(array_to_string(l[1:a - 1], chr(10))) + 1 ELSE 0 END AS c FROM g WHERE a <= z)
SELECT project_id, relative_path, sha256(trim(raw, {WS})) AS hash, line_start, line_end, c::INTEGER AS char_start, (c + length(raw))::INTEGER AS char_end
FROM t WHERE length(trim(raw, {WS})) >= 40""")
def gap_fill(spark, d):
    files = on.files(spark, d)
    size = F.size(text.lines(F.col("content")))
    many = files.withColumn("n", size).where("n >= 6").select("project_id", "relative_path", "n", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 6).cast("int") - 1)).alias("k"))
    intervals = many.select("project_id", "relative_path", (6 * F.col("k") + 3).alias("line_start"), F.least(6 * F.col("k") + 5, F.col("n")).alias("line_end"), F.col("k").alias("seq"))
    return gaps.fill_gaps(intervals, files, ChunkConfig(min_chunk=40)).select("project_id", "relative_path", "hash", "line_start", "line_end", "char_start", "char_end")


@query(f"""WITH {FILES}, {SMALL} SELECT relative_path, line_start, '[block] (anonymous) (lines ' || line_start || '-' || line_end || ', ' || char_count || ' chars)' AS shown,
  '[block] (anonymous) @ ' || relative_path || ':' || line_start || '-' || line_end || ' (hash: ' || left(hash, 8) || '...)' AS shown_hashed FROM chunks""")
def debug_string(spark, d):
    c = F.col
    shown = text.text_chunk_string(c("type"), c("name"), c("line_start"), c("line_end"), c("char_count"))
    hashed = text.hashed_chunk_string(c("type"), c("name"), c("relative_path"), c("line_start"), c("line_end"), c("hash"))
    return on.chunks(spark, d).select("relative_path", "line_start", shown.alias("shown"), hashed.alias("shown_hashed"))


@query(f"""WITH {FILES}, {SMALL}, n AS (SELECT c.*, lag(line_end) OVER w AS b, lead(line_start) OVER w AS a, string_split(f.content, chr(10)) AS l
  FROM chunks c JOIN files f USING (project_id, relative_path) WINDOW w AS (PARTITION BY relative_path ORDER BY line_start, line_end))
SELECT relative_path, line_start, sha256(list_aggregate(list_filter([array_to_string(l[greatest(b - 5, 0) + 1:b], chr(10)), code, array_to_string(l[a:a + 4], chr(10))], lambda x: x <> ''),
  'string_agg', chr(10) || chr(10) || '// ---' || chr(10) || chr(10))) AS overlap_hash FROM n""")
def neighbour_context(spark, d):
    found = context.with_neighbours(on.chunks(spark, d), on.files(spark, d))
    return found.select("relative_path", "line_start", F.sha2("overlap_text", 256).alias("overlap_hash"))


@query(f"WITH {FILES}, {SMALL} SELECT relative_path, list(hash ORDER BY line_start) AS payload, count(*) AS n FROM chunks GROUP BY relative_path")
def file_payload(spark, d):
    return lines.file_payload(on.chunks(spark, d)).drop("project_id")


_LINE = "chr(10)"


@query(f"""WITH {FILES}, p AS (SELECT project_id, relative_path, content, doc_id, doc_id % 5 AS k,
  regexp_replace(translate(content, {WS}, '      '), '[^A-Za-z ]', '', 'g') AS prose FROM files),
py AS (SELECT *, 'import os' || {_LINE} || {_LINE} || '# ' || prose || {_LINE} || {_LINE} AS a, '@cached' || {_LINE} AS deco,
  'def f' || doc_id || '(a, b=1):' || {_LINE} || '    ''''''' || prose || '''''''' || {_LINE} || '    return a' AS f,
  'class Cf' || doc_id || ':' || {_LINE} || '    def one(self):' || {_LINE} || '        return ''' || prose || '''' AS c FROM p WHERE k < 2),
ts AS (SELECT *, 'import x from ''y'';' || {_LINE} || '// ' || prose || {_LINE} AS a,
  'async function f' || doc_id || '(a: string, b: number): string {{' || {_LINE} || '  // ' || prose || {_LINE} || '  return `${{a}} {{`;' || {_LINE} || '}}' AS f,
  'class Kf' || doc_id || ' {{' || {_LINE} || '  run(a) {{' || {_LINE} || '    return "' || prose || '";' || {_LINE} || '  }}' || {_LINE} || '}}' AS c FROM p WHERE k IN (2, 3)),
one AS (
  SELECT project_id, relative_path, 'python' AS language_id, CASE WHEN length(deco || f) <= 8000 THEN deco || f ELSE f END AS t, 'function' AS type,
    CASE WHEN length(deco || f) > 8000 THEN 'f' || doc_id END AS name, CASE WHEN length(deco || f) <= 8000 THEN 5 ELSE 6 END AS line_start, 8 AS line_end,
    length(a) + CASE WHEN length(deco || f) <= 8000 THEN 0 ELSE length(deco) END AS char_start, false AS gap_fill FROM py
  UNION ALL SELECT project_id, relative_path, 'python', c, 'class', 'Cf' || doc_id, 11, 13, length(a || deco || f) + 3, false FROM py
  UNION ALL SELECT project_id, relative_path, 'python', left(a, -1) || CASE WHEN length(deco || f) <= 8000 THEN '' ELSE {_LINE} || '@cached' END, 'block', NULL, 1,
    CASE WHEN length(deco || f) <= 8000 THEN 4 ELSE 5 END, 0, true FROM py
  UNION ALL SELECT project_id, relative_path, 'typescript', CASE WHEN length(f) + 7 <= 8000 THEN 'export ' || f ELSE f END, CASE WHEN length(f) + 7 <= 8000 THEN 'block' ELSE 'function' END,
    'f' || doc_id, 3, 6, length(a) + CASE WHEN length(f) + 7 <= 8000 THEN 0 ELSE 7 END, false FROM ts
  UNION ALL SELECT project_id, relative_path, 'typescript', c, 'class', 'Kf' || doc_id, 8, 12, length(a || f) + 7 + 2, false FROM ts
  UNION ALL SELECT project_id, relative_path, 'typescript', left(a, -1), 'block', NULL, 1, 2, 0, true FROM ts),
sized AS (SELECT *, CASE WHEN gap_fill THEN trim(t, {WS}) ELSE t END AS body FROM one),
{windows_sql(50, 40, "(SELECT project_id, relative_path, content FROM p WHERE k = 4)", "plain", 20)}
SELECT project_id, relative_path, sha256(body) AS hash, type, name, language_id, line_start::INTEGER AS line_start, line_end::INTEGER AS line_end, char_start::INTEGER AS char_start,
  (char_start + length(t))::INTEGER AS char_end, length(body)::INTEGER AS char_count, gap_fill, false AS fallback FROM sized WHERE length(body) >= 20
UNION ALL SELECT project_id, relative_path, hash, 'block', NULL, 'python', line_start, line_end, char_start, char_end, char_count, false, true FROM plain""")
def ast_chunks(spark, d):
    return syntax.chunk_files(syntax.sample_sources(on.files(spark, d)), ChunkConfig(min_chunk=20)).drop("text")


# Merkle trees ---------------------------------------------------------------------------------------

_LEAVES = f"""{FILES}, leaves AS (SELECT project_id, relative_path, sha256(relative_path || content) AS hash,
  row_number() OVER (PARTITION BY project_id ORDER BY relative_path) - 1 AS idx FROM files)"""
_TREE = f"""{_LEAVES}, n AS (SELECT project_id, count(*) AS n FROM leaves GROUP BY project_id),
tree AS (
  SELECT 0 AS level, project_id, list(hash ORDER BY idx) AS h FROM leaves GROUP BY project_id
  UNION ALL
  SELECT level + 1, project_id, list_transform(range(0, (len(h) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(h) THEN sha256(h[2 * i + 1] || h[2 * i + 2]) ELSE h[2 * i + 1] END)
  FROM tree WHERE len(h) > 1)"""


@query(f"WITH {_LEAVES} SELECT project_id, relative_path, hash, idx FROM leaves")
def merkle_leaves(spark, d):
    return merkle.in_order(merkle.leaves(on.files(spark, d)))


@query(f"WITH RECURSIVE {_TREE} SELECT project_id, h[1] AS root, n AS n_files FROM tree JOIN n USING (project_id) WHERE len(h) = 1")
def merkle_root(spark, d):
    return merkle.roots(merkle.leaves(on.files(spark, d)))


@query(f"""WITH RECURSIVE {_TREE} SELECT project_id, level::INTEGER AS level, (i - 1)::BIGINT AS idx, h[i] AS hash
FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM tree)""")
def merkle_levels(spark, d):
    return merkle.nodes(merkle.leaves(on.files(spark, d)))


@query(f"""WITH RECURSIVE {_TREE}, r AS (SELECT project_id, h[1] AS root FROM tree WHERE len(h) = 1),
server AS (SELECT project_id, CASE WHEN project_id < 'src2' THEN root ELSE reverse(root) END AS server_root FROM r WHERE project_id <> 'src0')
SELECT 'u1' AS user_id, project_id, root IS DISTINCT FROM server_root AS changed, server_root FROM r LEFT JOIN server USING (project_id)""")
def root_check(spark, d):
    mine = merkle.roots(merkle.leaves(on.files(spark, d))).select(F.lit("u1").alias("user_id"), "project_id", "root")
    mine = materialize(mine, "roots")
    stored = F.when(F.col("project_id") < "src2", F.col("root")).otherwise(F.reverse("root"))
    return merkle.check_roots(mine, mine.where("project_id <> 'src0'").withColumn("root", stored))


_SNAPSHOT = """fresh AS (SELECT project_id, relative_path, CASE WHEN doc_id % 7 = 0 THEN content || '!' ELSE content END AS content, doc_id FROM files WHERE doc_id % 10 <> 0),
snap AS (SELECT * FROM fresh UNION ALL SELECT project_id, relative_path || '.copy', content, doc_id FROM fresh WHERE doc_id % 11 = 0)"""


@query(f"""WITH {FILES}, {_SNAPSHOT}
SELECT project_id, relative_path, CASE WHEN o.content IS NULL THEN 'added' WHEN s.content IS NULL THEN 'removed' WHEN o.content = s.content THEN 'unchanged' ELSE 'modified' END AS status
FROM files o FULL OUTER JOIN snap s USING (project_id, relative_path)""")
def snapshot_diff(spark, d):
    return merkle.diff(merkle.leaves(on.files(spark, d)), merkle.leaves(on.snapshot(spark, d)))


@query(f"""WITH {FILES}, {_SNAPSHOT}, {SMALL}, {windows_sql(8, 6, "snap", "later")},
a AS (SELECT DISTINCT project_id, hash FROM chunks), b AS (SELECT DISTINCT project_id, hash FROM later)
SELECT project_id, hash, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'unchanged' END AS status
FROM (SELECT project_id, hash FROM a UNION SELECT project_id, hash FROM b) LEFT JOIN a USING (project_id, hash) LEFT JOIN b USING (project_id, hash)""")
def chunk_diff(spark, d):
    return merkle.chunk_diff(on.chunks(spark, d), lines.line_windows(on.snapshot(spark, d), on.SMALL))


# Caches and synchronisation -------------------------------------------------------------------------

_SYNC = f"{FILES}, {SMALL}, {CACHED}"


@query(f"WITH {_SYNC} SELECT project_id, relative_path, line_start, hash, hash IN (SELECT hash FROM cached) AS hit FROM chunks")
def cache_split(spark, d):
    found = cache.with_hits(on.chunks(spark, d).drop("text"), on.cached_hashes(spark, d))
    return found.select("project_id", "relative_path", "line_start", "hash", "hit")


@query(f"WITH {_SYNC} SELECT project_id, hash FROM chunks WHERE hash NOT IN (SELECT hash FROM cached)")
def needed_hashes(spark, d):
    return cache.needed(on.chunks(spark, d), on.cached_hashes(spark, d))


@query(f"WITH {_SYNC} SELECT relative_path, line_start, hash, length(code)::INTEGER AS code_chars FROM chunks WHERE hash NOT IN (SELECT hash FROM cached)")
def needed_chunks(spark, d):
    chunks = on.chunks(spark, d)
    wanted = cache.needed(chunks, on.cached_hashes(spark, d))
    return cache.needed_chunks(chunks, wanted).select("relative_path", "line_start", "hash", F.length("text").alias("code_chars"))


@query(f"""WITH {_SYNC} SELECT project_id, count(*) AS received, count(c.hash) AS hits, count(*) - count(c.hash) AS needed, count(DISTINCT c.hash) AS vectorized
FROM chunks LEFT JOIN cached c USING (hash) GROUP BY project_id""")
def sync_phase1(spark, d):
    return sync.phase1(on.chunks(spark, d), on.cached_hashes(spark, d))


_PHASE2 = f"""m AS (SELECT * FROM chunks WHERE hash NOT IN (SELECT hash FROM cached)), ok AS (SELECT *, left(hash, 1) <> '0' AS good FROM m)"""


def _failing_embedder(hashes):
    """Vectors of the first 8 bytes of a hash; the zero vector where it begins with 0: a model's failure."""
    return [[0.0] * 8 if h.startswith("0") else [float(int(h[i], 16) + 1) for i in range(8)] for h in hashes]


def _phase2(spark, d, only_missing: bool):
    chunks = on.chunks(spark, d).withColumn("user_id", F.lit("u1")).withColumnRenamed("text", "code").withColumn("seq", F.struct("relative_path", "line_start"))
    known = on.cached_hashes(spark, d).withColumn("summary", F.lit("known")).withColumn("embedding", F.lit([1.0, 2.0]).cast("array<float>"))
    if only_missing:
        chunks = chunks.join(known.select("hash"), "hash", "left_anti")
    state = sync.State(known, None, None)
    by_hash = lambda codes, language: [hashing_of(c) for c in codes]
    config = EngineConfig(dimensions=8)
    after, counts = sync.process(chunks, state, cache.literal_time("2024-01-01 00:00:00") - F.expr("interval 1 day"), 1, by_hash, _failing_embedder, config)
    return after, counts


def hashing_of(code: str) -> str:
    from hashlib import sha256

    return sha256(code.encode("utf-8", "surrogatepass")).hexdigest()


@query(f"""WITH {_SYNC}, {_PHASE2} SELECT 'u1' AS user_id, project_id, count(*) AS received, count(*) AS processed, 0::BIGINT AS hits,
  count(DISTINCT hash) FILTER (good) AS stored, CASE WHEN bool_and(good) THEN 'indexed' ELSE 'partial' END AS status FROM ok GROUP BY project_id""")
def sync_phase2(spark, d):
    return _phase2(spark, d, True)[1]


@query(f"""WITH {_SYNC}, j AS (SELECT *, hash IN (SELECT hash FROM cached) AS hit FROM chunks), k AS (SELECT *, hit OR left(hash, 1) <> '0' AS good FROM j)
SELECT 'u1' AS user_id, project_id, count(*) AS received, count(*) FILTER (NOT hit) AS processed, count(*) FILTER (hit) AS hits,
  count(DISTINCT hash) FILTER (good) AS stored, CASE WHEN bool_and(good) THEN 'indexed' ELSE 'partial' END AS status FROM k GROUP BY project_id""")
def index_init(spark, d):
    return _phase2(spark, d, False)[1]


@query(f"""WITH {_SYNC}, j AS (SELECT *, hash IN (SELECT hash FROM cached) AS hit FROM chunks)
SELECT DISTINCT 'u1_' || project_id || '_' || hash AS id, project_id, hash, hit FROM j WHERE hit OR left(hash, 1) <> '0'""")
def index_vectors(spark, d):
    rows = _phase2(spark, d, False)[0].vectors
    return rows.select("id", "project_id", "hash", (F.col("summary") == "known").alias("hit"))


@query(f"WITH {_SYNC} SELECT project_id, hash, CASE WHEN hash IN (SELECT hash FROM cached) THEN 'cached' ELSE 'needed' END AS state FROM chunks")
def hash_categorize(spark, d):
    return sync.categorize(on.chunks(spark, d), on.cached_hashes(spark, d))


@query(f"""WITH {_SYNC}, live AS (SELECT hash FROM cached WHERE expires_at > TIMESTAMP '{AS_OF}')
SELECT project_id, count(*) FILTER (hash NOT IN (SELECT hash FROM live)) AS stored, count(*) FILTER (hash IN (SELECT hash FROM live)) AS skipped FROM chunks GROUP BY project_id""")
def hash_only_init(spark, d):
    return hash_only.init(on.chunks(spark, d), on.cached_hashes(spark, d), cache.literal_time(AS_OF))[1]


@query(f"""WITH {_SYNC}, live AS (SELECT hash FROM cached WHERE expires_at > TIMESTAMP '{AS_OF}')
SELECT project_id, hash, CASE WHEN hash IN (SELECT hash FROM live) THEN 'cached' ELSE 'needed' END AS state FROM chunks""")
def hash_only_phase1(spark, d):
    return hash_only.phase1(on.chunks(spark, d), on.cached_hashes(spark, d), cache.literal_time(AS_OF))[1]


@query(f"WITH {FILES}, {CACHED} SELECT hash, expires_at FROM cached WHERE expires_at > TIMESTAMP '{AS_OF}'")
def cache_ttl(spark, d):
    found = cache.alive(on.cached_hashes(spark, d), cache.literal_time(AS_OF))
    return found.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query(f"""WITH {_SYNC} SELECT c.hash, CASE WHEN c.hash IN (SELECT hash FROM chunks) AND expires_at > TIMESTAMP '{AS_OF}'
  THEN TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY ELSE expires_at END AS expires_at FROM cached c""")
def cache_refresh(spark, d):
    seen = on.chunks(spark, d)
    found = cache.refresh(on.cached_hashes(spark, d), seen, cache.literal_time(AS_OF), EngineConfig().hash_ttl_days)
    return found.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query(f"""WITH {_SYNC}, new AS (SELECT DISTINCT hash FROM chunks)
SELECT hash, TIMESTAMP '{AS_OF}' + INTERVAL 90 DAY AS expires_at FROM new UNION ALL SELECT hash, expires_at FROM cached WHERE hash NOT IN (SELECT hash FROM new)""")
def cache_put(spark, d):
    new = on.chunks(spark, d).select("hash").distinct()
    found = cache.put(on.cached_hashes(spark, d), new, cache.literal_time(AS_OF), EngineConfig().embedding_ttl_days)
    return found.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query(f"WITH {_SYNC} SELECT project_id, round(avg((hash IN (SELECT hash FROM cached))::INTEGER), 6) AS hit_rate FROM chunks GROUP BY project_id")
def hit_rate(spark, d):
    return cache.hit_rate(cache.with_hits(on.chunks(spark, d), on.cached_hashes(spark, d)), ["project_id"])


@query(f"WITH {_SYNC} SELECT project_id, round(100.0 * sum((hash IN (SELECT hash FROM cached))::INTEGER)::DOUBLE / count(*), 1) AS saved FROM chunks GROUP BY project_id")
def bandwidth_savings(spark, d):
    return cache.savings(cache.with_hits(on.chunks(spark, d), on.cached_hashes(spark, d)), ["project_id"])


@query(f"""WITH {_SYNC}, j AS (SELECT *, hash IN (SELECT hash FROM cached) AS hit FROM chunks)
SELECT count(*) AS received, count(*) FILTER (hit) AS cached, count(*) FILTER (NOT hit) AS sent, count(DISTINCT project_id) AS projects,
  'synced ' || count(*) || ' chunks' AS message FROM j""")
def sync_summary(spark, d):
    return cache.summary(cache.with_hits(on.chunks(spark, d), on.cached_hashes(spark, d)))


@query(f"""WITH {FILES}, {SMALL} SELECT 'user-' || project_id AS user_id, project_id, count(*) AS received, count(*) AS processed, 0::BIGINT AS hits,
  count(DISTINCT hash) AS stored, 'indexed' AS status FROM chunks GROUP BY project_id""")
def full_sync(spark, d):
    files = on.files(spark, d).withColumn("user_id", F.concat(F.lit("user-"), F.col("project_id")))
    config = EngineConfig(chunks=on.SMALL, dimensions=64)
    return sync.sync(files.drop("doc_id"), _no_state(spark), cache.literal_time(AS_OF), 1, config)[1]


def _no_state(spark):
    empty = spark.createDataFrame([], "hash string, summary string, embedding array<float>, expires_at timestamp")
    return sync.State(empty, None, spark.createDataFrame([], "user_id string, project_id string, root string"))


@query(f"""WITH RECURSIVE {FILES}, own AS (SELECT 'u' || (doc_id % 3) AS user_id, project_id, relative_path, content FROM files), {windows_sql(8, 6, "(SELECT user_id, project_id, relative_path, content FROM own)", "mine").replace("SELECT project_id, relative_path, sha256", "SELECT user_id, project_id, relative_path, sha256")},
tree AS (
  SELECT user_id, project_id, list(sha256(relative_path || content) ORDER BY relative_path) AS h FROM own GROUP BY user_id, project_id
  UNION ALL
  SELECT user_id, project_id, list_transform(range(0, (len(h) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(h) THEN sha256(h[2 * i + 1] || h[2 * i + 2]) ELSE h[2 * i + 1] END)
  FROM tree WHERE len(h) > 1)
SELECT user_id, project_id, 'vector' AS kind, user_id || '_' || project_id || '_' || hash AS id, last(relative_path ORDER BY relative_path, line_start) AS relative_path FROM mine GROUP BY user_id, project_id, hash
UNION ALL SELECT user_id, project_id, 'root', h[1], NULL FROM tree WHERE len(h) = 1""")
def sync_tenants(spark, d):
    """Three users that share all project ids: their vectors, files and roots stay their own."""
    files = on.files(spark, d).withColumn("user_id", F.concat(F.lit("u"), (F.col("doc_id") % 3).cast("string"))).drop("doc_id")
    state, _ = sync.sync(files, _no_state(spark), cache.literal_time(AS_OF), 1, EngineConfig(chunks=on.SMALL, dimensions=64))
    vectors = state.vectors.select("user_id", "project_id", F.lit("vector").alias("kind"), "id", "relative_path")
    return vectors.unionByName(state.roots.select("user_id", "project_id", F.lit("root").alias("kind"), F.col("root").alias("id"), F.lit(None).cast("string").alias("relative_path")))


# Vectors and search ---------------------------------------------------------------------------------


@query(f"""WITH {FILES}, {SMALL} SELECT relative_path, line_start, left('user-' || project_id, 8) || '_' || left(project_id, 8) || '_' || left(hash, 16) AS id,
  'user-' || project_id || '_' || project_id || '_' || hash AS full_id, left(hash, 16) AS hash_part FROM chunks""")
def vector_id(spark, d):
    user = F.concat(F.lit("user-"), F.col("project_id"))
    short = hashing.vector_id(user, F.col("project_id"), F.col("hash"))
    full = hashing.vector_id(user, F.col("project_id"), F.col("hash"), full=True)
    return on.chunks(spark, d).select("relative_path", "line_start", short.alias("id"), full.alias("full_id"), hashing.hash_of_vector_id(short).alias("hash_part"))


@query("SELECT vec_id, vec_id % 5 = 0 AS zero FROM embeddings")
def zero_filter(spark, d):
    made = F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda v: v * 0)).otherwise(F.col("embedding"))
    return on.vectors(spark, d).select("vec_id", is_zero(made).alias("zero"))


@query("""WITH b AS (SELECT vec_id, label, 1 AS version, embedding AS v FROM embeddings
  UNION ALL SELECT vec_id, label + 100, 2, list_transform(embedding, lambda x: -x) FROM embeddings WHERE vec_id % 3 = 0)
SELECT vec_id, arg_max(label, version) AS tenant, max(version)::INTEGER AS version, list_transform(arg_max(v, version), lambda x: round(x::DOUBLE, 6) + 0.0) AS embedding
FROM b GROUP BY vec_id""")
def vector_upsert(spark, d):
    old = on.vectors(spark, d).withColumn("version", F.lit(1)).withColumn("seq", F.col("vec_id"))
    negated = F.transform("embedding", lambda v: -v)
    new = old.where("vec_id % 3 = 0").withColumn("version", F.lit(2)).withColumn("tenant", F.col("tenant") + 100).withColumn("embedding", negated)
    shown = F.transform("embedding", lambda v: F.round(v.cast("double"), 6) + F.lit(0.0))
    return vector_index.upsert(old, new).select("vec_id", "tenant", "version", shown.alias("embedding"))


@query("SELECT vec_id, label AS tenant FROM embeddings WHERE vec_id % 4 <> 0")
def vector_delete(spark, d):
    rows = on.vectors(spark, d)
    return vector_index.delete(rows, rows.where("vec_id % 4 = 0")).select("vec_id", "tenant")


#: Queries are all rows whose id is divisible by 50, against all rows. Cosines are ranked at 12 decimals and shown to 6.
_SCORES = """s AS (SELECT q.vec_id AS query_id, q.label AS qt, lpad(e.vec_id::VARCHAR, 10, '0') AS id, e.label AS tenant,
  round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS score
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)"""


def _search(spark, d, mode: str, k: int):
    rows = on.vectors(spark, d)
    queries = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "tenant", F.col("embedding").alias("vector"))
    return vector_index.search_all(rows, queries, k, EngineConfig(search_mode=mode), ("tenant",))


@query(f"""WITH {_SCORES} SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank
  FROM s WHERE tenant = qt) WHERE rank <= 10""")
def search_exact(spark, d):
    return _search(spark, d, "exact", 10)


@query(f"""WITH {_SCORES}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, id, round(score, 6) AS score FROM top WHERE r <= 20 AND tenant = qt""")
def search_postfilter(spark, d):
    return _search(spark, d, "faithful", 20)


@query(f"""WITH {_SCORES}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s),
k AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank FROM top WHERE r <= 9 AND tenant = qt)
SELECT query_id, rank, id, round(score, 6) AS score FROM k WHERE rank <= 3""")
def search_ranked(spark, d):
    return _search(spark, d, "faithful", 3)


_INDEXED = f"""{FILES}, {SMALL}, rows AS (SELECT *, list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(hash, i, 1)))::DOUBLE) AS v FROM chunks),
indexed AS (SELECT project_id, hash, last(relative_path ORDER BY relative_path, line_start) AS relative_path, last(line_start ORDER BY relative_path, line_start) AS line_start,
  last(line_end ORDER BY relative_path, line_start) AS line_end, any_value(v) AS v FROM rows GROUP BY project_id, hash)"""


@query(f"""WITH {_INDEXED}, q AS (SELECT f.doc_id AS query_id, c.project_id, c.v FROM rows c JOIN files f USING (relative_path) WHERE c.line_start = 1 AND f.doc_id % 50 = 0),
s AS (SELECT query_id, e.*, round(list_cosine_similarity(q.v, e.v), 12) AS score FROM q JOIN indexed e USING (project_id)),
k AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hash))::INTEGER AS rank FROM s)
SELECT query_id, rank, 'u1_' || project_id || '_' || hash AS id, round(score, 6) AS score, hash, 'of ' || hash AS summary, 'block' AS type, CAST(NULL AS VARCHAR) AS name, 'text' AS language_id,
  line_start, line_end, relative_path FROM k WHERE rank <= 10""")
def search_details(spark, d):
    vector = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.conv(F.substr("hash", i, F.lit(1)), 16, 10).cast("int") + 1).cast("float"))
    chunks = on.chunks(spark, d).withColumn("user_id", F.lit("u1")).withColumn("embedding", vector).withColumn("summary", F.concat(F.lit("of "), F.col("hash")))
    rows = vector_index.to_rows(chunks.withColumn("version", F.lit(1)).withColumn("seq", F.struct("relative_path", "line_start")))
    index = materialize(vector_index.upsert(rows.limit(0), rows), "index")
    doc = F.regexp_extract("relative_path", r"(\d+)\.txt$", 1).cast("long")
    queries = chunks.where("line_start = 1").where(doc % 50 == 0).select(doc.alias("query_id"), "user_id", "project_id", F.col("embedding").alias("vector"))
    return vector_index.with_details(vector_index.search_all(index, queries, 10), index)


@query(f"""WITH {FILES}, {SMALL} SELECT relative_path, line_start, line_end, CAST(NULL AS VARCHAR) AS name, '' AS stored_name FROM chunks""")
def metadata_round_trip(spark, d):
    flat = on.chunks(spark, d).withColumn("stored_name", F.coalesce("name", F.lit("")))
    back = vector_index.from_rows(flat.withColumn("name", F.col("stored_name")))
    return back.select("relative_path", "line_start", "line_end", "name", "stored_name")


# Events ---------------------------------------------------------------------------------------------

_EVENTS = """ev AS (SELECT user_id AS project_id, 'src/f' || json_extract_string(props, '$.k') || '.ts' AS path, ts, event_id,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'update' WHEN 'click' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'sync' END AS event_type FROM events)"""


@query(f"""WITH {_EVENTS} SELECT project_id, path, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY ts DESC, event_id DESC) AS r
  FROM ev WHERE event_type <> 'sync') WHERE r = 1 AND event_type <> 'delete'""")
def leaf_fold(spark, d):
    return merkle.fold_events(on.file_events(spark, d).where("event_type <> 'sync'")).select("project_id", "path", "event_type", "event_id")


_DIRTY = f"""WITH {_EVENTS}, last AS (SELECT project_id, max(ts) AS t FROM ev WHERE event_type = 'sync' GROUP BY project_id)
SELECT DISTINCT project_id, path FROM ev LEFT JOIN last USING (project_id) WHERE event_type <> 'sync' AND (t IS NULL OR ts > t)"""


@query(_DIRTY)
def dirty_files(spark, d):
    from loomdex.streaming.dirty import dirty_since_sync

    return dirty_since_sync(on.file_events(spark, d))


@query(f"""WITH {_EVENTS}, p AS (SELECT *, lag(event_type) OVER (PARTITION BY project_id, path ORDER BY ts, event_id) AS prev FROM ev WHERE event_type <> 'sync')
SELECT project_id, path, event_id FROM p WHERE event_type <> 'delete' AND (prev IS NULL OR prev = 'delete')""")
def create_dedup(spark, d):
    from loomdex.streaming.watch import creations

    return creations(on.file_events(spark, d).where("event_type <> 'sync'")).select("project_id", "path", "event_id")


@query(f"""WITH {_EVENTS} SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, project_id, count(DISTINCT path) AS n_paths, list_sort(list(DISTINCT path)) AS paths
FROM ev WHERE event_type <> 'sync' GROUP BY 1, 2""")
def sync_windows(spark, d):
    from loomdex.streaming.dirty import dirty_by_window

    found = dirty_by_window(on.file_events(spark, d).where("event_type <> 'sync'"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(_DIRTY)
def stream_dirty(spark, d):
    from loomdex.streaming.dirty import drain_dirty

    return drain_dirty(spark, on.file_events(spark, d))


# Models, prompts, requests --------------------------------------------------------------------------


@query("""WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS i FROM conversations)
SELECT role AS language_id, i // 50 AS batch, count(*) AS n, sum(length(text))::BIGINT AS chars FROM r GROUP BY 1, 2""")
def batch_by_language(spark, d):
    rows = table(spark, d, "conversations").select(F.col("role").alias("language_id"), "conv_id", "turn", F.length("text").alias("c"))
    placed = with_positions(rows, ["language_id"], [F.col("conv_id"), F.col("turn")])
    return placed.groupBy("language_id", F.floor(F.col("idx") / 50).alias("batch")).agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


@query("""WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS i FROM conversations)
SELECT role AS language_id, i // 50 AS batch, sha256(string_agg('[CHUNK ' || (i % 50 + 1) || ']' || chr(10) || text || chr(10), chr(10) ORDER BY i)) AS prompt_hash FROM r GROUP BY 1, 2""")
def summary_prompt(spark, d):
    rows = table(spark, d, "conversations").select(F.col("role").alias("language_id"), "conv_id", "turn", "text")
    placed = with_positions(rows, ["language_id"], [F.col("conv_id"), F.col("turn")])
    codes = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"])
    batches = placed.groupBy("language_id", F.floor(F.col("idx") / 50).alias("batch")).agg(codes.alias("codes"))
    return batches.select("language_id", "batch", F.sha2(text.chunk_prompt(F.col("codes")), 256).alias("prompt_hash"))


_RESPONSE = """r AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '[1] x' ELSE '<think>' || chr(10) || '[1] wrong</THINK>' || chr(10) || '  [2] second ' || regexp_replace(text, '\\s+', ' ', 'g') || chr(10)
  || '<b>[3] tag' || chr(10) || '[1]   first ' || turn || chr(10) || '[2] again' || chr(10) END AS response FROM conversations)"""


def _responses(spark, d):
    body = F.concat(
        F.lit("<think>\n[1] wrong</THINK>\n  [2] second "), F.regexp_replace("text", r"\s+", " "),
        F.lit("\n<b>[3] tag\n[1]   first "), F.col("turn").cast("string"), F.lit("\n[2] again\n"),
    )
    response = F.when(F.col("turn") % 4 == 3, "[1] x").otherwise(body)
    return table(spark, d, "conversations").select("conv_id", "turn", response.alias("response"))


@query(f"""WITH {_RESPONSE}, b AS (SELECT *, trim(regexp_replace(response, '(?is)<think>.*?</think>', '', 'g'), {WS}) AS body FROM r),
l AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '' AND x[1] <> '<') AS l FROM b)
SELECT conv_id, turn, CASE WHEN length(body) < 10 THEN ['Code chunk', 'Code chunk', 'Code chunk'] ELSE
  list_transform(range(1, 4), lambda i: coalesce(trim(regexp_replace(list_filter(l, lambda x: regexp_matches(x, '^\\[' || i || '\\]\\s*.+$'))[1], '^\\[\\d+\\]\\s*', ''), {WS}), 'Code chunk')) END AS summaries FROM l""")
def summary_parse(spark, d):
    return _responses(spark, d).select("conv_id", "turn", text.parse_summaries(F.col("response"), F.lit(3)).alias("summaries"))


def _standalone(i: int, before: str) -> str:
    cut = lambda lines: f"nullif(trim(regexp_replace({lines}[1], '^\\[\\d+\\]\\s*', ''), {WS}), '')"
    own = cut(f"list_filter(l, lambda x: regexp_matches(x, '^\\[{i}\\]\\s*.+$'))")
    return f"CASE WHEN length(body) < 10 THEN 'Code chunk' ELSE coalesce({own}, {cut(f'list_filter(l, lambda x: {before})')}, 'Code chunk') END"


@query(f"""WITH {_RESPONSE}, b AS (SELECT *, trim(regexp_replace(response, '(?is)<think>.*?</think>', '', 'g'), {WS}) AS body FROM r),
l AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '' AND x[1] <> '<') AS l FROM b),
s1 AS (SELECT *, {_standalone(1, "true")} AS s1 FROM l), s2 AS (SELECT *, {_standalone(2, "NOT contains(x, s1)")} AS s2 FROM s1),
s3 AS (SELECT *, {_standalone(3, "NOT contains(x, s1) AND NOT contains(x, s2)")} AS s3 FROM s2)
SELECT conv_id, turn, [s1, s2, s3] AS summaries FROM s3""")
def summary_parse_standalone(spark, d):
    ship(spark)
    parse = F.udf(lambda r: text.parse_summaries_standalone(r, 3), "array<string>", useArrow=True)
    return _responses(spark, d).select("conv_id", "turn", parse("response").alias("summaries"))


@query(f"WITH {_RESPONSE} SELECT conv_id, turn, regexp_replace(response, '(?is)<think>.*?</think>', '', 'g') AS stripped FROM r")
def strip_think(spark, d):
    return _responses(spark, d).select("conv_id", "turn", text.strip_thinking(F.col("response")).alias("stripped"))


@query("SELECT conv_id, len(string_split_regex(string_agg(text, ' ' ORDER BY turn), '[ \\t\\n\\x0B\\f\\r]+'))::INTEGER AS tokens FROM conversations GROUP BY conv_id")
def token_usage(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    grouped = table(spark, d, "conversations").groupBy("conv_id").agg(ordered.alias("texts"))
    return grouped.select("conv_id", text.token_usage(F.col("texts")).alias("tokens"))


@query(f"""WITH {FILES}, {SMALL} SELECT relative_path, line_start, sha256('File: ' || relative_path || chr(10) || 'Parent: ' || project_id || chr(10) || 'block: part ' || line_start || chr(10)
  || CASE WHEN line_start % 4 = 1 THEN 'Parameters: a, b' || chr(10) ELSE '' END || '---' || chr(10) || code) AS context_hash FROM chunks""")
def contextualize(spark, d):
    made = text.contextualized(
        F.col("relative_path"), F.col("project_id"), F.col("type"), F.concat(F.lit("part "), F.col("line_start").cast("string")),
        F.when(F.col("line_start") % 4 == 1, F.array(F.lit("a"), F.lit("b"))), F.lit(None).cast("string"), F.col("text"),
    )
    return on.chunks(spark, d).select("relative_path", "line_start", F.sha2(made, 256).alias("context_hash"))


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Basic abc' WHEN 2 THEN 'Bearer abc' WHEN 3 THEN 'Bearer dev-token-' ELSE 'Bearer dev-token-u' || doc_id END AS h FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Missing Authorization header' WHEN 1 THEN 'Invalid Authorization header format. Expected: Bearer {token}' WHEN 2 THEN 'Invalid token format' WHEN 3 THEN 'Token missing userId' END AS error,
  CASE WHEN doc_id % 6 > 3 THEN substr(h, 18) END AS user_id FROM r""")
def auth_tokens(spark, d):
    good = F.concat(F.lit("Bearer dev-token-u"), F.col("doc_id").cast("string"))
    k = F.col("doc_id") % 6
    header = F.when(k == 1, "Basic abc").when(k == 2, "Bearer abc").when(k == 3, "Bearer dev-token-").when(k > 3, good)
    return table(spark, d, "documents").select("doc_id", requests.auth_error(header).alias("error"), requests.user_of(header).alias("user_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'projectId is required' WHEN doc_id % 7 = 0 THEN 'merkleRoot is required' WHEN doc_id % 4 = 3 THEN 'phase must be 1 or 2'
  WHEN doc_id % 3 = 0 THEN 'chunks array is required' END AS error FROM documents""")
def request_validation(spark, d):
    n = F.col("doc_id")
    body = F.to_json(F.struct(
        F.when(n % 5 != 0, "p").alias("projectId"), F.when(n % 7 != 0, "r").alias("merkleRoot"),
        F.when(n % 4 != 3, 1).otherwise(3).alias("phase"), F.when(n % 3 != 0, F.array(F.lit("h"))).alias("chunks"),
    ))
    got = F.from_json(body, "projectId string, merkleRoot string, phase int, chunks array<string>")
    error = requests.request_error(got["projectId"], got["merkleRoot"], got["chunks"], got["phase"])
    return table(spark, d, "documents").select("doc_id", error.alias("error"))


@query(f"""WITH {FILES}, {SMALL} SELECT relative_path, line_start, hash, 'text code: ' || trim(regexp_replace(code, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS summary,
  64 AS dimensions, false AS failed FROM chunks""")
def summaries_and_embeddings(spark, d):
    chunks = on.chunks(spark, d).withColumnRenamed("text", "code").withColumn("language_id", F.lit("text"))
    made = models.embed(models.summarize(chunks, config=EngineConfig()), "summary", models.hashing_embedder(64), EngineConfig(dimensions=64))
    return made.select("relative_path", "line_start", "hash", "summary", F.size("embedding").alias("dimensions"), is_zero(F.col("embedding")).alias("failed"))
