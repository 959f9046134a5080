"""The registered queries of the sketch engine, on the tables documents, benchmark and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import u64
from ..operators import compare as C
from ..operators import prune, reorder
from ..operators.sketch import SketchParams, empty_cells, empty_documents, kmer_digest, mean_size, sketch
from ..sources import index as I  # noqa: E741
from ..sources.results import read_sparse, write_lines
from ..sources.sequences import read_file_list, read_records, run_table
from ..sources.work import cut, fresh_path

P = SketchParams(k=15, ls=6, w=12, densify=False)
FILLED = SketchParams(k=15, ls=4, w=12)
PERFECT = SketchParams(k=15, ls=6, w=12, e=2000, mode="perfect", densify=False)
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def dna(text: Column, gap: str = "") -> Column:
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", gap)), LETTERS, BASES)


def documents(spark: SparkSession, d: str, gap: str = "") -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("gid"), dna(F.col("text"), gap).alias("seq"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("gid"), dna(F.col("text")).alias("seq"))


def _docs_sketch(spark: SparkSession, d: str, p: SketchParams = P) -> DataFrame:
    """The documents' sketch, written once: what a query uses several times is made once."""
    return cut(sketch(documents(spark, d), p), "sketch")


def _docs_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same as rows, a document each: so it is compared without a shuffle of its cells."""
    return cut(sketch(documents(spark, d), P, rows=True), "rows")


def _gids(p: DataFrame, name: str) -> DataFrame:
    return p.withColumn(name, F.concat_ws(",", F.transform(name, lambda x: x.cast("string"))))


def _ids(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("gid"))


def _edges(spark, d):
    return reorder.edges(C.compare_self(_docs_rows(spark, d), P.s, 0.5), 0.5)


def _class_edges(spark, d):
    """Classes' members and the edges between their representatives: what weights and best neighbours need of _edges()."""
    c, found = C.class_pairs(_docs_rows(spark, d), P.s, 0.5)
    return cut(reorder.class_members(c, P.s, 0.5), "members"), reorder.class_edges(found, P.s, 0.5)


def _roundtrip(spark, d):
    docs = documents(spark, d)
    path = fresh_path(spark, "query")
    I.save(I.build(docs, _docs_sketch(spark, d), P), path)
    return I.load(spark, path).postings.groupBy("pos", "fp").agg(F.sum("n").cast("int").alias("n"))


def _positions(spark, d):
    """Positions 8 to 11 of a stored index."""
    docs = documents(spark, d)
    path = fresh_path(spark, "query")
    I.save(I.build(docs, _docs_sketch(spark, d), P), path)
    return I.read_positions(I.load(spark, path), 8, 11).select("pos", "fp", F.explode("gids").alias("gid"))


def _reparsed(spark, d):
    path = fresh_path(spark, "query")
    write_lines(C.sparse_lines(C.compare_self(_docs_rows(spark, d), P.s, 0.5), _ids(spark, d)), path)
    return read_sparse(spark, path)


def _fastx(spark, d):
    """Documents written as FASTA files and scanned again: records in file order, lengths as written. The files are as many as the partitions, in id order."""
    path = fresh_path(spark, "query")
    rows = documents(spark, d).repartitionByRange("gid").sortWithinPartitions("gid").select(F.concat(F.lit(">"), F.col("gid").cast("string"), F.lit("\n"), F.col("seq")))
    rows.write.option("compression", "gzip").text(path)
    return read_records(spark, path).select("gid", F.col("name").cast("long").alias("name_id"), F.length("seq").alias("seq_len"))


def _one_file(spark, d):
    """Documents written as plain FASTA files, by as many tasks as there are partitions and in id order, and scanned by several tasks for a file, each a range of its bytes."""
    path = fresh_path(spark, "query")
    rows = documents(spark, d).repartitionByRange("gid").sortWithinPartitions("gid").select(F.concat(F.lit(">"), F.col("gid").cast("string"), F.lit("\n"), F.col("seq")))
    rows.write.text(path)
    return read_records(spark, path, 1 << 16).select("gid", F.col("name").cast("long").alias("name_id"), F.length("seq").alias("seq_len"))


def _fof(spark, d):
    """Benchmark items, a FASTA file each, read through a list of files."""
    path = fresh_path(spark, "query")
    rows = items(spark, d).select(F.col("gid"), F.concat(F.lit(">"), F.col("gid").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))
    rows.repartition("gid").write.partitionBy("gid").text(f"{path}/files")
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/files").select(F.regexp_extract("path", "gid=([0-9]+)", 1).cast("long").alias("g"), "path")
    names.orderBy("g").select("path").coalesce(1).write.text(f"{path}/list")
    return read_file_list(spark, f"{path}/list/part-*").select("gid", "rec", F.length("seq").alias("seq_len"))


def _masses(spark, d):
    """The mass bound at each pair's number of matches. Probabilities outside 0 and 1 are brought back to the ends."""
    p = F.explode(F.array(*[F.lit(x) for x in (-0.5, 0.1, 0.5, 0.9, 1.5)])).alias("p")
    masses = spark.range(1, P.s + 1).select(F.col("id").alias("matches"), p)  # a pair's depend on its number of matches alone
    masses = masses.select("matches", "p", *[F.round(prune.log_mass(F.col("matches"), F.lit(n), F.col("p")), 6).alias(f"log_mass_{n}") for n in (10, 64)])
    pairs = C.pair_counts(*[_docs_rows(spark, d)] * 2, half=True)
    return pairs.join(F.broadcast(masses), "matches").select("qid", "rid", "p", "log_mass_10", "log_mass_64")


def _stored(spark, docs):
    path = fresh_path(spark, "query")
    I.save(I.build(docs, cut(sketch(docs, P), "sketch"), P), path)
    return I.load(spark, path)


def _stored_self(threshold):
    """Stored posting lists compared with themselves, list by list."""

    def run(spark, d):
        index = _stored(spark, documents(spark, d))
        return I.compare_stored(index, index, threshold).select("qid", "rid", "matches")

    return run


def _totals(threshold):
    def run(spark, d):
        q, r = cut(sketch(items(spark, d), P), "items"), _docs_sketch(spark, d)
        return C.totals(cut(C.compare(q, r, P.s, threshold), "hits"), items(spark, d), _ids(spark, d), threshold)

    return run


def _turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("gid"), dna(F.col("text")).alias("seq"))


def _conversation_digest(spark, d):
    """A conversation is a document, a turn one of its records."""
    return kmer_digest(_turns(spark, d), P.k).groupBy("gid").agg(F.sum("n_kmers").alias("n_kmers"))


def _order(spark, d):
    """Copies are one node of the walk; hits are made between representatives only."""
    rows = _docs_rows(spark, d)
    c = cut(C.classes(rows), "classes")
    reps = cut(C.representatives(rows, c), "representatives")
    return reorder.class_order(_ids(spark, d), c, C.compare_self(reps, P.s, 0.5), P.s, 0.5, rows=reps)


def _mixed(f):
    return lambda spark, d: _ids(spark, d).select("gid", f(F.col("gid")).alias("h"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with half of their positions or more in common."""
    return C.compare_self(_docs_rows(spark, d), P.s, 0.5).select("qid", "rid", "matches", "score")


QUERIES = {
    "s5_scan_docs": lambda s, d: documents(s, d).select("gid", F.length("seq").alias("seq_len")),
    "s6_mean_size": lambda s, d: mean_size(documents(s, d)),
    "s11_empty_docs": lambda s, d: empty_documents(documents(s, d), _docs_sketch(s, d)),
    "s6_pooled_mean_size": lambda s, d: mean_size(_turns(s, d), drop_empty=True),
    "s4_pooled_sketch": lambda s, d: sketch(_turns(s, d), P).select("gid", "pos", "h"),
    "s8_read_positions": _positions,
    "f1_runs": lambda s, d: run_table(documents(s, d, "-")),
    "f3_kmer_counts": lambda s, d: kmer_digest(documents(s, d, "-"), 5).select("gid", "n_kmers"),
    "s4_pooled_records": _conversation_digest,
    "k2_kmer_hashes": lambda s, d: kmer_digest(documents(s, d), P.k),
    "n1_fmix64": _mixed(u64.fmix64),
    "n2_xorshift": _mixed(u64.xorshift_star),
    "n3_hash_family": _mixed(lambda x: u64.hash_family(x, 3)),
    "k3_bucket_ids": lambda s, d: _ids(s, d).groupBy(u64.bucket_of(F.col("gid"), 6).alias("bucket")).agg(F.count("*").alias("n")),
    "k4_bucket_min": lambda s, d: _docs_sketch(s, d).select("gid", "pos", "h"),
    "a7_empty_cells": lambda s, d: empty_cells(documents(s, d), _docs_sketch(s, d), P),
    "k5_densified": lambda s, d: sketch(documents(s, d), FILLED).select("gid", "pos", "h"),
    "k9_whole_sketch": lambda s, d: sketch(documents(s, d), FILLED).select("gid", "pos", "fp"),
    "k6_fp_default": lambda s, d: _docs_sketch(s, d).select("gid", "pos", "fp"),
    "k7_fp_perfect": lambda s, d: _docs_sketch(s, d, PERFECT).select("gid", "pos", "fp"),
    "a4_postings": lambda s, d: _gids(I.postings(_docs_sketch(s, d)), "gids"),
    "n9_delta_postings": lambda s, d: _gids(I.deltas(I.postings(_docs_sketch(s, d))), "deltas"),
    "n9_roundtrip": lambda s, d: _gids(I.undeltas(I.deltas(I.postings(_docs_sketch(s, d)))), "gids"),
    "a12_index_stats": lambda s, d: I.build(documents(s, d), _docs_sketch(s, d), P).stats(),
    "s9_index_roundtrip": _roundtrip,
    "j1_pair_counts": lambda s, d: C.pair_counts(*[_docs_rows(s, d)] * 2),
    "j3_ref_vs_query": lambda s, d: C.compare(sketch(items(s, d), P, rows=True), _docs_rows(s, d), P.s),
    "j4_self_hits": lambda s, d: C.compare_self(_docs_rows(s, d), P.s).select("qid", "rid", "score"),
    "f7_threshold": flagship,
    "f12_partition_limit": lambda s, d: C.compare_self(*C.first_positions(_docs_rows(s, d), P.s, 20), 0.5),
    "n12_sparse_lines": lambda s, d: C.sparse_lines(C.compare_self(_docs_rows(s, d), P.s, 0.25), _ids(s, d)).select("line"),
    "j6_matrix_long": lambda s, d: C.matrix(C.compare(sketch(items(s, d), P, rows=True), _docs_rows(s, d), P.s, 0.05), items(s, d), _ids(s, d), 0.05),
    "n12_matrix_lines": lambda s, d: C.matrix_lines(cut(C.compare(sketch(items(s, d), P, rows=True), _docs_rows(s, d), P.s), "hits"), items(s, d), _ids(s, d)).select("line"),
    "a10_total_scores": _totals(0.0),
    "a10_thresholded_totals": _totals(0.05),
    "n5_log_mass": _masses,
    "j1_stored_lists": _stored_self(0.0),
    "f7_stored_lists": _stored_self(0.5),
    "j3_stored_lists": lambda s, d: I.compare_stored(_stored(s, items(s, d)), _stored(s, documents(s, d))),
    "n6_pruned_pairs": lambda s, d: prune.pruned_compare(*[_docs_rows(s, d)] * 2, P.s, 0.5).select("qid", "rid", "matches"),
    "pigeonhole_pairs": lambda s, d: C.prefix_compare(*[_docs_rows(s, d)] * 2, P.s, 0.5).select("qid", "rid", "matches"),
    "u1_edges": _edges,
    "a9_node_weight": lambda s, d: reorder.class_node_weights(_ids(s, d), *_class_edges(s, d)),
    "o7_start_node": lambda s, d: reorder.start_node(reorder.class_node_weights(_ids(s, d), *_class_edges(s, d))),
    "o8_best_neighbour": lambda s, d: reorder.class_best_neighbours(*_class_edges(s, d)),
    "o6_order_preview": lambda s, d: reorder.preview(_order(s, d)),
    "o9_order": _order,
    "o10_reordered_index": lambda s, d: _gids(I.postings(reorder.reordered(_docs_sketch(s, d), _order(s, d))), "gids"),
    "s1_fastx_scan": _fastx,
    "s2_one_file_scan": _one_file,
    "s3_fof_scan": _fof,
    "s12_sparse_reparse": _reparsed,
}

# DuckDB SQL. Hashes are made by window functions over single characters, independent of the numpy kernel.
_DNA = f"translate(lower(regexp_replace(text, '[^A-Za-z]', '%s', 'g')), '{LETTERS}', '{BASES}')"


def _rol(x: str, n: str) -> str:
    return f"(CASE WHEN ({n}) % 64 = 0 THEN ({x}) ELSE ((({x}) & ((1::UBIGINT << (64 - ({n}) % 64)) - 1)) << (({n}) % 64)) | (({x}) >> (64 - ({n}) % 64)) END)"


def _signed(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN {x}::HUGEINT - 18446744073709551616 ELSE {x}::HUGEINT END AS BIGINT)"


def _sql_times(x: str, c: int) -> str:
    return f"(((({x})::UHUGEINT) * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _steps(name: str, source: str, cols: str, x: str, kind: str) -> str:
    """CTEs {name}1.. that mix column x; the last, {name}, has it as m."""
    if kind == "fmix":
        first, last = f"xor({x}::UBIGINT, {x}::UBIGINT >> 33)", "xor(m, m >> 33)"
        return f"{name}1 AS (SELECT {cols}, {_sql_times(first, u64.MIX_A)} AS m FROM {source}), {name}2 AS (SELECT {cols}, {_sql_times(last, u64.MIX_B)} AS m FROM {name}1), {name} AS (SELECT {cols}, {last} AS m FROM {name}2)"
    shift = "((m & 549755813887::UBIGINT) << 25)"
    return f"{name}1 AS (SELECT {cols}, xor({x}::UBIGINT, {x}::UBIGINT >> 12) AS m FROM {source}), {name}2 AS (SELECT {cols}, xor(m, {shift}) AS m FROM {name}1), {name} AS (SELECT {cols}, {_sql_times('xor(m, m >> 27)', u64.STAR)} AS m FROM {name}2)"


def _kmers_sql(table: str, id_col: str, k: int, tag: str) -> str:
    """CTE {tag}k(gid, h): canonical hashes of the k-mers of a table's dna."""
    seed = "CASE c WHEN 'A' THEN 4362857412768957556 WHEN 'C' THEN 3572411708064410444 WHEN 'G' THEN 2319985823310095140 ELSE 2978368046464386134 END::UBIGINT"
    comp = "CASE c WHEN 'T' THEN 4362857412768957556 WHEN 'G' THEN 3572411708064410444 WHEN 'C' THEN 2319985823310095140 ELSE 2978368046464386134 END::UBIGINT"
    return f"""{tag}c AS (SELECT {id_col} AS gid, unnest(string_split(s, '')) AS c, unnest(range(0, length(s))) AS t FROM (SELECT {id_col}, {_DNA % ''} AS s FROM {table}) WHERE length(s) >= {k}),
{tag}x AS (SELECT gid, t, bit_xor({_rol(seed, '(64 - t % 64)')}) OVER w AS p, bit_xor({_rol(comp, 't')}) OVER w AS q FROM {tag}c WINDOW w AS (PARTITION BY gid ORDER BY t ROWS UNBOUNDED PRECEDING)),
{tag}y AS (SELECT gid, t, xor(p, coalesce(lag(p, {k}) OVER w, 0::UBIGINT)) AS f, xor(q, coalesce(lag(q, {k}) OVER w, 0::UBIGINT)) AS r FROM {tag}x WINDOW w AS (PARTITION BY gid ORDER BY t)),
{tag}k AS (SELECT gid, least({_rol('f', 't')}, {_rol('r', f'(64 - (t - {k - 1}) % 64)')}) AS h FROM {tag}y WHERE t >= {k - 1})"""


def _sketch_sql(table: str = "documents", id_col: str = "doc_id", tag: str = "", p: SketchParams = P) -> str:
    """CTE {tag}sk(gid, pos, u, h, fp)."""
    return f"""{_kmers_sql(table, id_col, p.k, tag)}, {_steps(tag + 'b', tag + 'k', 'gid, h', 'h', 'fmix')},
{tag}sk AS (SELECT gid, pos, u, {_signed('u')} AS h, CAST(u & {(1 << p.w) - 1} AS BIGINT) AS fp FROM (SELECT gid, CAST(m >> {64 - p.ls} AS INTEGER) AS pos, min(h) AS u FROM {tag}b GROUP BY ALL))"""


def _filled_sql() -> str:
    """CTE fl(gid, pos, u): sketches of FILLED, densified round by round. A cell (u, f, x) points, in round t, at (f + t * x) modulo the size."""
    size = FILLED.s
    return f"""WITH RECURSIVE {_sketch_sql(p=FILLED)}, {_steps('ff', 'sk', 'gid, pos, u', 'u', 'fmix')}, {_steps('xx', 'sk', 'gid, pos, u', 'u', 'star')},
ce AS (SELECT ff.gid, ff.pos, {{'u': ff.u, 'f': CAST(ff.m % {size} AS INTEGER), 'x': CAST(xx.m % {size} AS INTEGER)}} AS c FROM ff JOIN xx USING (gid, pos)),
st AS (SELECT gid, list(pos) AS ps, list(c) AS cs FROM ce GROUP BY gid),
de AS (
  SELECT gid, 0 AS step, list_transform(range({size}), lambda p: list_extract(cs, list_position(ps, p))) AS v, len(ps) AS n FROM st
  UNION ALL
  SELECT gid, step + 1, w, len(list_filter(w, lambda c: c IS NOT NULL)) FROM (
    SELECT gid, step, n, list_transform(range({size}), lambda p: coalesce(v[p + 1], list_filter(v, lambda c: c IS NOT NULL AND (c.f + step * c.x) % {size} = p)[1])) AS w FROM de WHERE n < {size})
  WHERE len(list_filter(w, lambda c: c IS NOT NULL)) > n),
la AS (SELECT gid, arg_max(v, step) AS v FROM de GROUP BY gid),
fl AS (SELECT gid, pos, c.u AS u FROM (SELECT gid, CAST(unnest(range({size})) AS INTEGER) AS pos, unnest(v) AS c FROM la) WHERE c IS NOT NULL)"""


def _walk_sql() -> str:
    """CTE wk(new_gid, old_gid): the greedy walk, a step a row, with the ids not yet visited, heaviest first."""
    return f"""{_WEIGHT.replace('WITH ', 'WITH RECURSIVE ', 1)},
ad AS (SELECT src, list(dst ORDER BY sim4 DESC, dst) AS near FROM (SELECT DISTINCT src, dst, sim4 FROM e) GROUP BY src),
hv AS (SELECT list(idx ORDER BY weight4 DESC, idx DESC) AS ids FROM nw),
wk AS (
  SELECT CAST(0 AS BIGINT) AS new_gid, ids[1] AS old_gid, ids[2:] AS rest FROM hv
  UNION ALL
  SELECT n, nx, list_filter(rest, lambda i: i <> nx) FROM (
    SELECT new_gid + 1 AS n, rest, coalesce(list_filter(near, lambda i: list_contains(rest, i))[1], rest[1]) AS nx FROM wk LEFT JOIN ad ON src = old_gid WHERE len(rest) > 0))"""


def _mass(n: int) -> str:
    c = f"least(matches, {n})::DOUBLE"
    return f"round(least(0.0::DOUBLE, {n} * ln(2.0::DOUBLE) - ln(pi() * {n} / 2) / 2 - 2 * ({c} - {n / 2}::DOUBLE) * ({c} - {n / 2}::DOUBLE) / {n} + 23.0::DOUBLE / {18 * n} + {c} * ln(b) + ({n} - {c}) * ln(1.0::DOUBLE - b)), 6)"


_SK = f"WITH {_sketch_sql()}"
_PAIRS = f"{_SK}, pr AS (SELECT a.gid AS qid, b.gid AS rid, count(*) AS matches FROM sk a JOIN sk b USING (pos, fp) GROUP BY ALL)"
_BENCH = f"WITH {_sketch_sql()}, {_sketch_sql('benchmark', 'item_id', 'i')}, pr AS (SELECT a.gid AS qid, b.gid AS rid, count(*) AS matches FROM isk a JOIN sk b USING (pos, fp) GROUP BY ALL)"
_S = f"{P.s}::DOUBLE"
_HITS = f"{_PAIRS}, hits AS (SELECT qid, rid, matches, matches / {_S} AS score FROM pr WHERE qid <> rid)"
_POST = f"{_SK}, po AS (SELECT pos, fp, CAST(count(*) AS INTEGER) AS n, list_sort(list(gid)) AS gids FROM sk GROUP BY ALL)"
_EDGE = f"{_HITS}, h4 AS (SELECT qid AS a, rid AS b, CAST(round_even(score * 10000, 0) AS BIGINT) AS sim4 FROM hits WHERE matches >= {P.s // 2}), e AS (SELECT a AS src, b AS dst, sim4 FROM h4 UNION ALL SELECT b, a, sim4 FROM h4)"
_WEIGHT = f"{_EDGE}, nw AS (SELECT doc_id AS idx, CAST(coalesce(w, 0) AS BIGINT) AS weight4 FROM documents LEFT JOIN (SELECT src, sum(sim4) AS w FROM e GROUP BY src) ON src = doc_id)"
_LOG = f"least(0.0::DOUBLE, (p + 1) * ln(2.0::DOUBLE) - ln(pi() * (p + 1) / 2) / 2 - 2 * (c + 1 - (p + 1) / 2.0::DOUBLE) * (c + 1 - (p + 1) / 2.0::DOUBLE) / (p + 1) + 23.0::DOUBLE / (18 * (p + 1)) + (c + 1) * ln(0.5::DOUBLE) + (p - c) * ln(0.5::DOUBLE))"
_ALLOW = f"CASE WHEN c + 1 >= {P.s // 2} THEN true WHEN {P.s // 2} - c - 1 > {P.s} - p - 1 THEN false WHEN (c + 1) / (p + 1)::DOUBLE >= 0.5 THEN true ELSE {_LOG} >= ln(0.001::DOUBLE) END"
_ONLY = "WITH d AS (SELECT doc_id AS gid FROM documents)"

ORACLES = {
    "s5_scan_docs": f"SELECT doc_id AS gid, CAST(length({_DNA % ''}) AS INTEGER) AS seq_len FROM documents",
    "s6_mean_size": f"SELECT CAST(coalesce(sum(n) // count(n), 5000000) AS BIGINT) AS e FROM (SELECT length({_DNA % ''}) AS n FROM documents ORDER BY doc_id LIMIT 100)",
    "s11_empty_docs": f"SELECT doc_id AS gid FROM documents WHERE length({_DNA % ''}) < {P.k}",
    "s6_pooled_mean_size": f"SELECT CAST(coalesce(sum(n) // count(n), 5000000) AS BIGINT) AS e FROM (SELECT sum(length({_DNA % ''})) AS n FROM conversations GROUP BY conv_id HAVING sum(length({_DNA % ''})) > 0 ORDER BY conv_id LIMIT 100)",
    "s4_pooled_sketch": f"WITH turns AS (SELECT conv_id, text, conv_id * 100000 + turn AS turn_id FROM conversations), {_kmers_sql('turns', 'turn_id', P.k, '')}, {_steps('b', 'k', 'gid, h', 'h', 'fmix')}, m AS (SELECT gid // 100000 AS gid, CAST(m >> {64 - P.ls} AS INTEGER) AS pos, min(h) AS u FROM b GROUP BY ALL) SELECT gid, pos, {_signed('u')} AS h FROM m",
    "s8_read_positions": f"{_SK} SELECT pos, fp, gid FROM sk WHERE pos BETWEEN 8 AND 11",
    "f1_runs": f"SELECT gid, CAST(unnest(range(0, len(r))) AS INTEGER) AS run_idx, CAST(length(unnest(r)) AS INTEGER) AS run_len FROM (SELECT doc_id AS gid, regexp_extract_all({_DNA % '-'}, '[ACGTacgt]+') AS r FROM documents)",
    "f3_kmer_counts": f"SELECT doc_id AS gid, CAST(list_sum(list_transform(regexp_extract_all({_DNA % '-'}, '[ACGT]+') || [''], lambda r: greatest(0, length(r) - 4))) AS BIGINT) AS n_kmers FROM documents",
    "s4_pooled_records": f"SELECT conv_id AS gid, CAST(sum(greatest(0, length({_DNA % ''}) - {P.k - 1})) AS BIGINT) AS n_kmers FROM conversations GROUP BY conv_id",
    "k2_kmer_hashes": f"WITH {_kmers_sql('documents', 'doc_id', P.k, '')} SELECT doc_id AS gid, coalesce(n, 0) AS n_kmers, coalesce({_signed('x')}, 0) AS h_xor FROM documents LEFT JOIN (SELECT gid, count(*) AS n, bit_xor(h) AS x FROM k GROUP BY gid) ON gid = doc_id",
    "n1_fmix64": f"{_ONLY}, {_steps('a', 'd', 'gid', 'gid', 'fmix')} SELECT gid, {_signed('m')} AS h FROM a",
    "n2_xorshift": f"{_ONLY}, {_steps('a', 'd', 'gid', 'gid', 'star')} SELECT gid, {_signed('m')} AS h FROM a",
    "n3_hash_family": f"{_ONLY}, {_steps('a', 'd', 'gid', 'gid', 'fmix')}, {_steps('b', 'd', 'gid', 'gid', 'star')}, c AS (SELECT gid, ((a.m::UHUGEINT + 3::UHUGEINT * b.m::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS m FROM a JOIN b USING (gid)) SELECT gid, {_signed('m')} AS h FROM c",
    "k3_bucket_ids": f"{_ONLY}, {_steps('a', 'd', 'gid', 'gid', 'fmix')} SELECT CAST(m >> 58 AS INTEGER) AS bucket, count(*) AS n FROM a GROUP BY ALL",
    "k4_bucket_min": f"{_SK} SELECT gid, pos, h FROM sk",
    "a7_empty_cells": f"{_SK} SELECT doc_id AS gid, CAST({P.s} - coalesce(n, 0) AS BIGINT) AS n_empty FROM documents LEFT JOIN (SELECT gid, count(*) AS n FROM sk GROUP BY gid) ON gid = doc_id",
    "k5_densified": f"{_filled_sql()} SELECT gid, pos, {_signed('u')} AS h FROM fl",
    "k9_whole_sketch": f"{_filled_sql()} SELECT gid, pos, CAST(u & {(1 << FILLED.w) - 1} AS BIGINT) AS fp FROM fl",
    "k6_fp_default": f"{_SK} SELECT gid, pos, fp FROM sk",
    "k7_fp_perfect": f"{_SK}, pf AS (SELECT gid, pos, pow((4294967296.0::DOUBLE - (u >> 32)::DOUBLE) / 4294967296.0::DOUBLE, {PERFECT.e / PERFECT.s}::DOUBLE) AS x FROM sk) SELECT gid, pos, CAST(least(floor(4096.0::DOUBLE - 4096.0::DOUBLE * x), 4095.0::DOUBLE) AS BIGINT) AS fp FROM pf WHERE x > pow(2.0::DOUBLE, -114)",
    "a4_postings": f"{_POST} SELECT pos, fp, n, array_to_string(gids, ',') AS gids FROM po",
    "n9_delta_postings": f"{_POST} SELECT pos, fp, n, array_to_string(list_transform(range(1, len(gids) + 1), lambda i: CASE WHEN i = 1 THEN gids[1] ELSE gids[i] - gids[i - 1] END), ',') AS deltas FROM po",
    "n9_roundtrip": f"{_POST} SELECT pos, fp, n, array_to_string(gids, ',') AS gids FROM po",
    "a12_index_stats": f"{_SK} SELECT {P.s} AS s, {1 << P.w}::BIGINT AS fp_range, (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM documents) - count(DISTINCT gid) AS n_empty FROM sk",
    "s9_index_roundtrip": f"{_POST} SELECT pos, fp, n FROM po",
    "j1_pair_counts": f"{_PAIRS} SELECT qid, rid, matches FROM pr",
    "j3_ref_vs_query": f"{_BENCH} SELECT qid, rid, matches, matches / {_S} AS score FROM pr",
    "j4_self_hits": f"{_HITS} SELECT qid, rid, score FROM hits",
    "f7_threshold": f"{_HITS} SELECT qid, rid, matches, score FROM hits WHERE matches >= {P.s // 2}",
    "f12_partition_limit": f"{_SK}, pr AS (SELECT a.gid AS qid, b.gid AS rid, count(*) AS matches FROM sk a JOIN sk b USING (pos, fp) WHERE pos < 20 GROUP BY ALL) SELECT qid, rid, matches, matches / 20.0::DOUBLE AS score FROM pr WHERE qid <> rid AND matches >= 10",
    "n12_sparse_lines": f"{_HITS} SELECT 'query_' || doc_id || chr(9) || coalesce(l, '') AS line FROM documents LEFT JOIN (SELECT qid, string_agg(rid || ':' || printf('%.4f', score), ',' ORDER BY matches DESC, rid) AS l FROM hits WHERE matches >= {P.s // 4} GROUP BY qid) ON qid = doc_id",
    "j6_matrix_long": f"{_BENCH} SELECT item_id AS qid, doc_id AS rid, CASE WHEN coalesce(matches / {_S}, 0) >= 0.05 THEN matches / {_S} ELSE 0.0::DOUBLE END AS score FROM benchmark CROSS JOIN documents LEFT JOIN pr ON qid = item_id AND rid = doc_id",
    "n12_matrix_lines": f"{_BENCH} SELECT 'query_' || item_id || chr(9) || string_agg(printf('%.4f', coalesce(matches / {_S}, 0.0::DOUBLE)), ',' ORDER BY doc_id) AS line FROM benchmark CROSS JOIN documents LEFT JOIN pr ON qid = item_id AND rid = doc_id GROUP BY item_id",
    "a10_total_scores": f"{_BENCH} SELECT 'sparse' AS mode, count(*) AS total FROM pr UNION ALL SELECT 'matrix', (SELECT count(*) FROM benchmark) * (SELECT count(*) FROM documents)",
    "a10_thresholded_totals": f"{_BENCH}, t AS (SELECT count(*) AS n FROM pr WHERE matches >= ceil(0.05::DOUBLE * {P.s})) SELECT unnest(['sparse', 'matrix']) AS mode, n AS total FROM t",
    "n6_pruned_pairs": f"{_SK}, ho AS (SELECT a.gid AS qid, b.gid AS rid, list(a.pos ORDER BY a.pos) AS ps FROM sk a JOIN sk b USING (pos, fp) GROUP BY ALL), fo AS (SELECT qid, rid, list_reduce(list_prepend(0, ps), lambda c, p: CASE WHEN {_ALLOW} THEN c + 1 ELSE 0 END) AS matches FROM ho) SELECT qid, rid, CAST(matches AS BIGINT) AS matches FROM fo WHERE matches >= {P.s // 2}",
    "n5_log_mass": f"{_PAIRS}, g AS (SELECT qid, rid, matches, unnest([-0.5::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE, 1.5::DOUBLE]) AS p FROM pr WHERE qid <= rid), v AS (SELECT *, greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, p)) AS b FROM g) SELECT qid, rid, p, {_mass(10)} AS log_mass_10, {_mass(64)} AS log_mass_64 FROM v",
    "j1_stored_lists": f"{_PAIRS} SELECT qid, rid, matches FROM pr",
    "f7_stored_lists": f"{_PAIRS} SELECT qid, rid, matches FROM pr WHERE matches >= {P.s // 2}",
    "j3_stored_lists": f"{_BENCH} SELECT qid, rid, matches, matches / {_S} AS score FROM pr",
    "pigeonhole_pairs": f"{_PAIRS} SELECT qid, rid, matches FROM pr WHERE matches >= {P.s // 2}",
    "u1_edges": f"{_EDGE} SELECT src, dst, sim4 FROM e",
    "a9_node_weight": f"{_WEIGHT} SELECT idx, weight4 FROM nw",
    "o7_start_node": f"{_WEIGHT} SELECT idx, weight4 FROM nw ORDER BY weight4 DESC, idx DESC LIMIT 1",
    "o8_best_neighbour": f"{_EDGE} SELECT src AS idx, dst AS best, sim4 FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim4 DESC, dst) = 1",
    "o6_order_preview": f"{_walk_sql()} SELECT new_gid, old_gid FROM wk WHERE new_gid < 8",
    "o9_order": f"{_walk_sql()} SELECT new_gid, old_gid FROM wk",
    "o10_reordered_index": f"{_walk_sql()} SELECT pos, fp, CAST(count(*) AS INTEGER) AS n, string_agg(new_gid, ',' ORDER BY new_gid) AS gids FROM sk JOIN wk ON gid = old_gid GROUP BY pos, fp",
    "s1_fastx_scan": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS gid, doc_id AS name_id, CAST(length({_DNA % ''}) AS INTEGER) AS seq_len FROM documents",
    "s2_one_file_scan": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS gid, doc_id AS name_id, CAST(length({_DNA % ''}) AS INTEGER) AS seq_len FROM documents",
    "s3_fof_scan": f"SELECT row_number() OVER (ORDER BY item_id) - 1 AS gid, 0::BIGINT AS rec, CAST(length({_DNA % ''}) AS INTEGER) AS seq_len FROM benchmark",
    "s12_sparse_reparse": f"{_HITS} SELECT qid, rid, printf('%.4f', score)::DOUBLE AS score FROM hits WHERE matches >= {P.s // 2}",
}
