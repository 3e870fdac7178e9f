"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline

from lumatable.plans.session import checkpoint_dir

from . import centroids, langid, line_dedup, mixing, pieces, prefixes, quality, sharding, simhash, substrings, token_files, urls, vector_search
from .common import read_table, stage_table


def op1_line_dedup(spark, sf_dir):
    """Lines kept and dropped in every document; its source is the site."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.dedup_lines(docs)
    return out.select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_dropped",
        F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"),
    )


OP1_SQL = rf"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
on_pages AS (
  SELECT source, line, count(DISTINCT doc_id) AS n FROM lines
  WHERE trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY source, line
), bad AS (
  SELECT o.source, o.line FROM on_pages o JOIN pages p ON o.source IS NOT DISTINCT FROM p.source
  WHERE n >= {line_dedup.MIN_PAGES} AND n > {line_dedup.MAX_RATIO}::DOUBLE * pages
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.line IS NOT NULL) AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.line IS NULL), '') AS text
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line
  GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  length(k.text) AS kept_chars, sha256(k.text) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def op2_quality_rules(spark, sf_dir):
    """Base counts and the verdict of the line labeller for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "quality.*")


def op3_language_id(spark, sf_dir):
    """Predicted language of every document; a fifth of them is held out from training."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    trees = langid.fit(docs.filter(~held))
    out = langid.predicted(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score")


def op4_url_filters(spark, sf_dir):
    """Host, path, rule and verdict of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages).select("page_id", "url_filter.*")


def _glob_regex(glob):
    out = "".join({"*": ".*", "+": "[^/]*", "?": "."}.get(c, c if c.isalnum() or c in "/-_=&" else "\\" + c) for c in glob)
    return f"(?s)^{out}$".replace("'", "''")


def _op4_sql():
    fits = "\n".join(
        f"    WHEN ends_with('.' || host, '.{r[: r.index('/')]}') AND starts_with(path, '{r[r.index('/'):]}') THEN '{r}'"
        for r, _ in sorted(urls.RULES, key=lambda r: -len(r[0]))
    )
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in urls.RULES)
    globs = " OR ".join(f"regexp_matches(url, '{_glob_regex(g)}')" for g in urls.BLOCKED)
    return rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM rest
), named AS (
  SELECT page_id, rest, path, query, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts
), judged AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN rest IS NULL OR rest = '' THEN '' ELSE '.' || host || path || query END AS url,
    CASE
{fits}
    END AS rule
  FROM named
)
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE WHEN {globs} THEN 'block' ELSE 'allow' END END AS verdict FROM judged
"""


def op5_sentencepiece(spark, sf_dir):
    """Piece ids of every document, and whether decoding them gives the text back."""
    return pieces.encoded(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_tokens", "ids", "round_trip"
    )


def op6_token_files(spark, sf_dir):
    """Place, number and checksum of every document's ids, read back from the written files."""
    return token_files.encoded(read_table(spark, sf_dir, "documents"), checkpoint_dir(spark))


def op7_substring_dedup(spark, sf_dir):
    """Words of every document, those removed, and the hash of the rest."""
    return substrings.dedup_substrings(read_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark, sf_dir):
    """How often the mix takes every document."""
    return mixing.mix_report(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP8_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM sizes GROUP BY source
), filled AS (
  SELECT *, {mixing.CAP} * source_size::DOUBLE AS cap, {mixing.CAP} * source_size::DOUBLE / weight AS full_at FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM filled WINDOW before AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), height AS (SELECT arg_min(level, full_at) AS height FROM levels WHERE level <= full_at),
targets AS (
  SELECT source, source_size, CASE WHEN full_at < height THEN cap ELSE weight * height END AS target FROM levels, height
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share FROM targets
), parts AS (SELECT *, floor(share) AS whole, (share - floor(share)) * source_size AS part FROM shares),
ordered AS (
  SELECT s.doc_id, s.size, p.*, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN part > 0 AND run + size / 2 <= part THEN 1 ELSE 0 END))::BIGINT AS taken,
  (whole + CASE WHEN part > 0 AND run + size / 2 <= part THEN 1 ELSE 0 END)::BIGINT AS repeats
FROM ordered
"""


def op9_simhash(spark, sf_dir):
    """Fingerprint and group of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_vector_search(spark, sf_dir):
    """The 20 best other vectors for every 20th vector."""
    return vector_search.top_k(read_table(spark, sf_dir, "embeddings"))


OP10_SQL = f"""
WITH ints AS (
  SELECT row_number() OVER () AS n, vec_id,
    list_transform(embedding, lambda x: floor({vector_search.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM ints q JOIN ints c ON q.n <> c.n AND len(q.v) = len(c.v)
  WHERE q.vec_id % {vector_search.EVERY} = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) <= {vector_search.K}
"""


def op11_prefix_trie(spark, sf_dir):
    """Every node of the trie of rebuilt conversations, with figures of its subtree."""
    convs = stage_table(prefixes.rebuilt(read_table(spark, sf_dir, "conversations")), "rebuilt")
    nodes = prefixes.prefix_trie(convs)
    ended = nodes.filter("end_key IS NOT NULL").join(prefixes.end_digests(convs), "end_key")
    passed = nodes.filter("end_key IS NULL").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return ended.unionByName(passed).drop("end_key")


OP11_SQL = f"""
WITH own AS (
  SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (SELECT conv_id, list(t ORDER BY pos) AS ts FROM own GROUP BY conv_id),
heads AS (
  SELECT conv_id, ts, conv_id - conv_id % {prefixes.EVERY} AS base,
    xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % {prefixes.HEADS} AS h
  FROM lists
), built AS (
  SELECT a.conv_id, list_concat(coalesce(b.ts, [])[1 : a.h], a.ts[a.h + 1 :]) AS ts
  FROM heads a LEFT JOIN lists b ON a.base = b.conv_id
), depths AS (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS depth FROM built),
members AS (
  SELECT depth, ts[1 : depth] AS path, ts[1 : greatest(depth - 1, 0)] AS up, conv_id, len(ts) = depth AS is_end FROM depths
), nodes AS MATERIALIZED (
  SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '') AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE length(path[depth].text) END AS chars
  FROM members GROUP BY depth, path
), children AS (SELECT up AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up, depth),
sized AS (SELECT o.*, coalesce(c.n, 0) AS n_children FROM nodes o LEFT JOIN children c USING (depth, path)),
above AS (SELECT n, chars, n_children, unnest(range(depth + 1)) AS depth, path AS full_path FROM sized),
trees AS (
  SELECT depth, full_path[1 : depth] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n - 1) * chars)::BIGINT AS saved
  FROM above GROUP BY ALL
)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n AS n_convs, o.n_children, t.n_leaves, t.saved AS saved_tokens,
  sha256(o.ends) AS ends_sha256
FROM sized o JOIN trees t USING (depth, path) LEFT JOIN nodes p ON o.depth > 0 AND p.depth = o.depth - 1 AND p.path = o.up
"""


def op12_sharding(spark, sf_dir):
    """Shard and slot of every document; shards have equally many rows, to one."""
    size, check = sharding.sizes_and_checks(F.col("text"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), check.alias("text_crc32"))
    return sharding.sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard_place.*", F.lit(None).cast("int").alias("grown_shard")
    )


def op13_centroid_clustering(spark, sf_dir):
    """Cluster and distance of every vector, and figures of its cluster."""
    rows, found = centroids.cluster_vectors(read_table(spark, sf_dir, "embeddings"))
    rows = stage_table(rows, "clustered")
    # one row per centroid
    sums = dict(rows.groupBy("cluster").agg(centroids.sum_within_long(F.col("distance"))).collect())
    whole = None if None in sums.values() else sum(sums.values())
    inertia = whole if whole is not None and whole <= centroids.LAST else None
    figures = [
        (c, sums.get(c), inertia, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(found)
    ]
    figures = F.broadcast(spark.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return rows.join(figures, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _op13_sql():
    k, dim = centroids.K, centroids.DIM
    squares = "list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for r in range(centroids.ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT r, vec_id, any_value(v) AS v, min(struct_pack(d := {squares}, c := c)) AS best FROM ints, c{r} GROUP BY r, vec_id)"
        )
        if r < centroids.ROUNDS:
            steps.append(f"""p{r} AS (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}),
m{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM p{r} GROUP BY c, i),
n{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS w FROM m{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN n{r} USING (c))""")
    last = centroids.ROUNDS
    return f"""
WITH ints AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v,
    sha256('{centroids.SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS c, v AS w FROM ints QUALIFY row_number() OVER (ORDER BY h, v) <= {k}
), {", ".join(steps)}
SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON best.c = c{last}.c
"""


def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline, one after the other."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_url_filters": op4_url_filters,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_files": op6_token_files,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_simhash": op9_simhash,
    "op10_vector_search": op10_vector_search,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sharding": op12_sharding,
    "op13_centroid_clustering": op13_centroid_clustering,
    "pipeline": pipeline,
}
ORACLE = {
    "op1_line_dedup": OP1_SQL,
    "op4_url_filters": _op4_sql(),
    "op8_source_mixing": OP8_SQL,
    "op10_vector_search": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_centroid_clustering": _op13_sql(),
}
