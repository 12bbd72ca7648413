"""Command line: ``python -m orewright.cli {similarity,itemsets,triangles,clusters,sigma,partition} ...``; results are printed or written."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.operators import graph, partition, patterns, similarity, spectral
from orewright.session import get_session, materialize
from orewright.sources import readers, writers
from orewright.streaming import triest_stream


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="orewright")
    sub = parser.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple[str, object, str]) -> None:
        command = sub.add_parser(name)
        for flag, default, text in options:
            command.add_argument(f"-{flag}", f"--{flag}", dest=flag, type=type(default), default=default, help=f"{text} (default {default})")
        command.add_argument("-shared", "--shared", default="", help="folder that all executors share, for intermediate tables; needed on a cluster")
        command.add_argument("-out", "--out", default="", help="folder for the result; printed if not given")

    add("similarity", ("input", "data", "folder of text files"), ("k", 10, "length of shingles"), ("threshold", 0.8, "similarity for banding"), ("hashes", 150, "length of signatures"), ("seed", 1, "seed of the hashes"))
    add("itemsets", ("input", "baskets.dat", "file with a basket in each line"), ("support", 0.5, "share of baskets"), ("confidence", 0.5, "confidence of rules"))
    add("triangles", ("input", "edges.txt", "edge list"), ("method", "IMPR", "BASE or IMPR"), ("sample", 5000, "edges in the sample"), ("window", 0, "edges in a window; 0 for the sample's size"), ("seed", 0, "seed"))
    add("clusters", ("input", "points.csv", "numeric CSV"), ("k", 4, "clusters"), ("sigma", 1.5, "kernel width"), ("seed", 1, "seed"))
    add("sigma", ("input", "points.csv", "numeric CSV"), ("k", 4, "clusters"), ("seed", 1, "seed"))
    add(
        "partition", ("graph", "graph.txt", "adjacency file"), ("rounds", 1000, "rounds"), ("numPartitions", 4, "parts"), ("uniformRandSampleSize", 6, "random candidates"),
        ("randNeighborsSampleSize", 3, "neighbour candidates"), ("temp", 2.0, "start temperature"), ("delta", 0.001, "cooling"), ("seed", 0, "seed"), ("alpha", 2.0, "exponent"),
        ("graphInitColorSelectionPolicy", "ROUND_ROBIN", "ROUND_ROBIN, BATCH or RANDOM"), ("nodeSelectionPolicy", "HYBRID", "LOCAL, RANDOM or HYBRID"), ("annealing", "LINEAR", "LINEAR, LATE or EXPONENTIAL"),
    )
    return parser


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """The named results of a command."""
    if args.command == "similarity":
        docs = readers.read_documents(spark, args.input)
        exact = similarity.jaccard_pairs(similarity.shingle_sets(docs, "path", "text", args.k))
        hashed = similarity.shingle_sets(docs, "path", "text", args.k, "xxhash")
        signatures = materialize(similarity.minhash_signatures(hashed, args.hashes, args.seed), "signatures")
        return {"exact": exact, "candidates": similarity.score_candidates(similarity.lsh_candidates(signatures, args.threshold, args.hashes), signatures)}
    if args.command == "itemsets":
        long = patterns.distinct_baskets(readers.read_baskets(spark, args.input), "basket_id", "items")
        found = materialize(patterns.find_frequent_items(long, args.support), "itemsets")
        return {"itemsets": found, "rules": patterns.get_rules(found, args.confidence)}
    if args.command == "triangles":
        edges = materialize(graph.canonical_edges(readers.read_edges(spark, args.input), seq="seq"), "edges")
        path = edges.inputFiles()[0].rsplit("/", 1)[0]
        stream = triest_stream.triest_stream(spark.readStream.schema(edges.schema).parquet(path), args.sample, args.method, args.seed)
        return {"windows": triest_stream.count_windows(triest_stream.run_to_table(stream, f"{path}-stream"), args.window or args.sample)}
    if args.command == "clusters":
        return {"clusters": spectral.spectral_cluster(readers.read_points(spark, args.input), args.k, args.sigma, args.seed)}
    if args.command == "sigma":
        return {"sigma": spectral.optimal_sigma(readers.read_points(spark, args.input), args.k, seed=args.seed)}
    vertices, arcs = readers.read_adjacency(spark, args.graph)
    config = partition.Config(
        args.rounds, args.numPartitions, args.uniformRandSampleSize, args.randNeighborsSampleSize, args.temp, args.delta, args.alpha, args.seed,
        args.graphInitColorSelectionPolicy, args.nodeSelectionPolicy, args.annealing,
    )
    coloured, metrics = partition.jabeja(arcs, config, vertices.select(F.col("id").alias("vertex")))
    return {"colours": coloured, "rounds": metrics}


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    for name, df in run(get_session(app=f"orewright {args.command}", shared=args.shared or None), args).items():
        if args.out and name == "rounds":
            writers.write_report(df, f"{args.out}/{name}", **{k: v for k, v in vars(args).items() if k not in ("command", "out", "shared")})
        elif args.out:
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        else:
            print(name)
            df.show(100, truncate=False)


if __name__ == "__main__":
    main()
