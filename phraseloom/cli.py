"""Command line: python -m phraseloom.cli mine PATH --out DIR, or tree RESULTS --out DIR."""

from __future__ import annotations

import argparse

from phraseloom.operators import grams, sequences, tree
from phraseloom.operators.miners import Params
from phraseloom.plans.registry import mine
from phraseloom.plans.tables import settle
from phraseloom.session import session
from phraseloom.sources import corpus, exchange


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="phraseloom")
    commands = out.add_subparsers(dest="command", required=True)
    m = commands.add_parser("mine", help="find repeated phrases")
    m.add_argument("path", help="a folder of files, a delimited file, or a Parquet table with doc_id and text")
    m.add_argument("--out", required=True)
    m.add_argument("--n", type=int, default=10, help="least support")
    m.add_argument("--ngrams", type=int, default=4, help="seed length")
    m.add_argument("--min-l", "--min_l", type=int, default=0, help="least phrase length; 0: the seed length")
    m.add_argument("--algo", default="default")
    m.add_argument("--max-l", type=int, default=16, help="greatest length, for the miners that need one")
    m.add_argument("--mask", default="")
    m.add_argument("--csv-delimiter", "--csv-delim", default=",")
    m.add_argument("--sampling", type=float, default=1.0)
    m.add_argument("--seed", type=int, default=0)
    m.add_argument("--strict-compat", action="store_true")
    m.add_argument("--stats", action="store_true", help="print n-gram statistics")
    t = commands.add_parser("tree", help="arrange results in a hierarchy")
    t.add_argument("path")
    t.add_argument("--out", required=True)
    t.add_argument("--limit", type=int, default=15000)
    t.add_argument("--min-l", "--min_l", type=int, default=0)
    t.add_argument("--min-f", "--min_f", type=int, default=0)
    return out


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = session()
    if a.command == "mine":
        docs = corpus.read_corpus(spark, a.path, a.mask, a.csv_delimiter, a.sampling, a.seed)
        tokens = settle(grams.with_tokens(docs), "tokens")
        if a.stats:
            sequences.mining_stats(tokens, a.ngrams, a.n).show()
        found = settle(mine(tokens, a.algo, Params(a.n, a.ngrams, a.min_l), docs.select("doc_id", "source"), a.max_l, a.strict_compat), "results")
        exchange.write_results(found, a.out, ellipsis=a.algo == "prefixspan")
        print(f"{found.count()} phrases in {a.out}")
        return
    results = tree.clean_results(corpus.read_results(spark, a.path), a.min_l, a.min_f)
    if results.isEmpty():
        print("no results")
        return
    built = settle(tree.build_tree(results), "tree")
    exchange.write_tree(built, f"{a.out}/tree")
    exchange.write_html(built, f"{a.out}/tree.html", a.limit)
    print(f"{built.count()} phrases in {a.out}")


if __name__ == "__main__":
    main()
