"""Command line: `python -m tessera.cli sketch ...` and `compare ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import compare as C
from .operators import prune
from .operators.reorder import class_order, preview, reordered
from .operators.sketch import SketchParams, mean_size, sketch
from .sources import index as I  # noqa: E741
from .sources.results import write_lines
from .sources.sequences import count_listed, read_file_list, read_records
from .sources.work import cut


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    commands = p.add_subparsers(dest="command", required=True)
    for name, s_size in (("sketch", 10), ("compare", 16)):
        c = commands.add_parser(name)
        c.add_argument("-o", "--output", required=True)
        c.add_argument("-k", "--k_size", type=int, default=31)
        c.add_argument("-s", "--s_size", type=int, default=s_size)
        c.add_argument("-w", "--w_size", type=int, default=16)
        c.add_argument("-e", "--e_size", type=int)
        c.add_argument("--sketch-mode", choices=("default", "perfect"), default="default")
        c.add_argument("--threads", type=int, help="cores of a local session that this command starts; a running session keeps its own")
        c.add_argument("--zstd-level", type=int, default=1, help="of the index (sketch) or of the result (compare); 0: a plain result")
        c.add_argument("--no-compress", action="store_true", help="an index without compression")
        if name == "sketch":
            source = c.add_mutually_exclusive_group(required=True)
            source.add_argument("--input-fof")
            source.add_argument("--input-fasta")
            c.add_argument("--reorder-similarity", action="store_true")
            c.add_argument("--reorder-threshold", type=float, default=0.5)
            c.add_argument("--reorder-sample", type=int, default=100)
        else:
            for side in ("ref", "query"):
                for kind in ("sketch", "fof", "fasta"):
                    c.add_argument(f"--{side}-{kind}")
            c.add_argument("--threshold", type=float, default=0.0)
            c.add_argument("--matrix", action="store_true")
            c.add_argument("--print-stats", action="store_true")
            c.add_argument("--prob-threshold-heuristic", action="store_true", help="drop pairs that are unlikely to reach the threshold; true ones can be lost")
            c.add_argument("--prob-threshold-probability", type=float, default=0.001)
            c.add_argument("--shard-zstd-level", type=int, help="accepted and not used: Spark's shuffle has settings of its own")
            c.add_argument("--temp-dir", help="accepted and not used: spark.local.dir and spark.checkpoint.dir say where")
    return p


def _index(spark: SparkSession, a: argparse.Namespace, fof: str | None, fasta: str | None, say=print) -> tuple[I.Index, DataFrame]:
    docs = cut(read_file_list(spark, fof) if fof else read_records(spark, fasta), "documents")
    e = a.e_size or (mean_size(docs, drop_empty=bool(fof)).first()["e"] if a.sketch_mode == "perfect" else 5_000_000)
    params = SketchParams(a.k_size, a.s_size, a.w_size, e, a.sketch_mode)
    sk = cut(sketch(docs, params, unique=not fof, rows=True), "sketch")
    found = I.build(docs, sk, params, count_listed(spark, fof) if fof else None)
    if found.n_empty:
        say(f"warning: {found.n_empty} documents have no sketch; they keep their ids")
    return found, sk


def main(args: list[str] | None = None, spark: SparkSession | None = None, say=print) -> None:
    a = parser().parse_args(args)
    if spark is None:
        builder = SparkSession.builder
        spark = (builder.master(f"local[{a.threads}]") if a.threads else builder).getOrCreate()
    if a.command == "sketch":
        found, sk = _index(spark, a, a.input_fof, a.input_fasta, say)
        if a.reorder_similarity:
            cells, s = C.first_positions(sk, found.params.s, a.reorder_sample)
            least = max(0.0, min(1.0, a.reorder_threshold))
            cells = cut(cells, "first-positions")
            kinds = cut(C.classes(cells), "classes")
            hits = C.compare_self(cut(C.representatives(cells, kinds), "representatives"), s, least)
            order = cut(class_order(sk.select("gid"), kinds, hits, s, least), "order")
            say("first of the new order: " + " ".join(str(r["old_gid"]) for r in preview(order).collect()))
            found = I.dealt_index(reordered(sk, order), found.params, found.n_docs, found.n_empty, order, found.n_ids)
        I.save(found, a.output, "uncompressed" if a.no_compress else "zstd", None if a.no_compress else max(1, a.zstd_level))
        return
    sides, made = {}, {}
    for side in ("ref", "query"):
        stored, fof, fasta = (getattr(a, f"{side}_{k}") for k in ("sketch", "fof", "fasta"))
        if stored or fof or fasta:
            sides[side], made[side] = (I.load(spark, stored), None) if stored else _index(spark, a, fof, fasta, say)
    if "ref" not in sides:
        raise SystemExit("a reference is needed")
    ref, query = sides["ref"], sides.get("query", sides["ref"])
    ref.check(query)
    if a.print_stats:
        for side, index in sides.items():
            say(f"{side}: " + ", ".join(f"{k} {v}" for k, v in index.stats().first().asDict().items()))
    s, alone = ref.params.s, not a.matrix and "query" not in sides
    pruned = a.prob_threshold_heuristic and a.threshold > 0
    if not pruned and a.ref_sketch and (query is ref or a.query_sketch):
        hits = I.compare_stored(query, ref, a.threshold)
    else:
        r = cut(ref.sketch(), "ref") if a.ref_sketch else made["ref"]
        q = r if query is ref else cut(query.sketch(), "query") if a.query_sketch else made["query"]
        hits = prune.pruned_compare(q, r, s, a.threshold, a.prob_threshold_probability) if pruned else C.compare(q, r, s, a.threshold)
    hits = cut(hits.where("qid <> rid") if alone else hits, "hits")
    lines = C.matrix_lines(hits, query.ids(), ref.ids(), a.threshold) if a.matrix else C.sparse_lines(hits, query.ids())
    write_lines(lines, a.output, a.zstd_level)
    total = {x["mode"]: x["total"] for x in C.totals(hits, query.ids(), ref.ids(), a.threshold).collect()}
    say(f"{total['matrix' if a.matrix else 'sparse']} scores")


if __name__ == "__main__":
    main()
