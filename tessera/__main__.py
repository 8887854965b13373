"""python -m tessera ingest|query|inspect|benchmark|stats|interactive ..."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from tessera.operators import evaluate, generate
from tessera.plans.pipeline import MODES, Retrieval
from tessera.sources.loaders import evaluation_samples


def shown(rows) -> None:
    rows.show(20, truncate=100)


def answers(rows) -> None:
    """Each answer with its sources below."""
    for row in rows.collect():  # of the one question that was asked
        print(f"\n{row.query_text}\n\n{row.answer}\n")
        for c in row.citations or []:
            print(f"  {c.label} {c.source}, chunk {c.chunk_index}, score {c.score:.4f}\n      {c.preview}")


def stages(rows) -> None:
    """Each hit with the score of every stage."""
    score = lambda x: "-" if x is None else f"{x:.4f}"
    for row in rows.orderBy("rank").collect():  # top-k of one question
        print(f"{row['rank']:>3} {row.chunk_id}  dense {score(row.dense_score)}  bm25 {score(row.bm25_score)}  fused {score(row.rrf_score)}  reranked {score(row.rerank_score)}")
        print(f"    {row.content[:120]!r}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("--index", default="index")
    parser.add_argument("--mode", choices=MODES, default="hybrid")
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--documents", help="a folder that is ingested first if the index is empty")
    parser.add_argument("--hosted-model", action="store_true", help="answers by a hosted model; the key is in GEMINI_API_KEY")
    parser.add_argument("command", choices=("ingest", "query", "inspect", "benchmark", "stats", "interactive"))
    parser.add_argument("what", nargs="*")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    engine = Retrieval.neural(spark, args.index, answer=generate.hosted_model(api_key=os.environ.get("GEMINI_API_KEY")) if args.hosted_model else None)
    if args.documents and not engine.manager.version():
        print(engine.ingest_directory(args.documents))

    def run(command: str, text: str) -> None:
        queries = spark.createDataFrame([(0, text)], "query_id long, text string")
        if command == "ingest":
            print(engine.ingest_directory(text) if os.path.isdir(text) else engine.ingest_file(text))
        elif command == "query":
            answers(engine.query(queries, args.top_k, args.mode))
        elif command == "inspect":
            stages(engine.inspect(queries, args.top_k))
        elif command == "benchmark":
            print(evaluate.table(engine.compare(evaluation_samples(spark, text)), args.top_k))
        else:
            shown(engine.manager.stats())

    if args.command != "interactive":
        run(args.command, " ".join(args.what))
        return
    while (line := input("> ").strip()) not in ("/exit", "/quit"):
        command, _, text = line.partition(" ")
        if command == "/mode" and text in MODES:
            args.mode = text
        elif command in ("/ingest", "/query", "/inspect", "/benchmark", "/stats"):
            run(command[1:], text)
        elif command == "/clear":
            print("\033[2J\033[H", end="")  # the terminal is blank, and goes on at its top
        elif command == "/help":
            print("/ingest PATH, /query TEXT, /inspect TEXT, /benchmark FILE, /mode MODE, /stats, /clear, /exit; other text is a query")
        elif line:
            run("query", line)


if __name__ == "__main__":
    main()
