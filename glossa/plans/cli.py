"""Command line: train and apply the plans. ``python -m glossa.plans.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon, sequence, stats, vocab
from ..session import local_session
from ..sources import readers
from ..timing import LOG
from . import clscl, tagger

EXITS = ("quit", "bye", "q")


def _lexicons(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    out = {}
    if args.clusters:
        out["brown"] = readers.read_clusters(spark, args.clusters)
    for name in ("places", "orgs", "firstnames", "lastnames"):
        if path := getattr(args, name):
            entries = spark.read.text(path).withColumnRenamed("value", "entry")
            out[name] = lexicon.gazetteer(entries, "bilou") if name in ("places", "orgs") else lexicon.simple_gazetteer(entries)
    return out


def _tokens(spark: SparkSession, args: argparse.Namespace, path: str) -> DataFrame:
    return readers.read_conll(spark, path, args.lang, raw=getattr(args, "raw", False), tags=tuple(t for t in args.tags.split(",") if t))


def ner_train(spark: SparkSession, args: argparse.Namespace) -> None:
    aso = tagger.Subspace.load(spark, args.aso) if args.aso else None
    readers = [(_tokens(spark, args, args.train), args.least), *((_tokens(spark, args, path), args.least) for path in args.also)]
    prefixes = tuple(p for p in args.pos.split(",") if p)
    model = tagger.train(spark, readers, args.features, args.learner, args.least, args.reg, args.epochs, args.eph, _lexicons(spark, args), args.seed, aso, prefixes)
    model.save(args.model)


def ner_predict(spark: SparkSession, args: argparse.Namespace) -> None:
    tokens = _tokens(spark, args, args.test)
    tagged = tagger.Tagger.load(spark, args.model, _lexicons(spark, args)).tag(tokens, args.scope)
    readers.write_predictions(tagged, args.output, args.raw)
    if not args.raw:
        sequence.chunk_scores(tagged).orderBy("type").show()


def ner_aso(spark: SparkSession, args: argparse.Namespace) -> None:
    """Learns a subspace of word context; --list shows its auxiliary tasks instead."""
    tokens, prefixes = _tokens(spark, args, args.train), tuple(p for p in args.pos.split(",") if p)
    if args.list:
        print("\n".join(tagger.list_tasks(tagger.auxiliary(spark, tokens, args.tasks, "rr09_aso", args.least, prefixes, not args.fewer)[2])))
        return
    tagger.aso(spark, tokens, args.tasks, args.dims, least=args.least, visits=args.visits, pos_prefixes=prefixes, strict=not args.fewer).save(args.model)


def ner_demo(spark: SparkSession, args: argparse.Namespace) -> None:
    """Reads sentences until one of EXITS and prints token/tag."""
    model = tagger.Tagger.load(spark, args.model, _lexicons(spark, args))
    while (line := input("> ").strip()) not in EXITS:
        tokens = readers.split_sentence(spark.createDataFrame([(0, line)], "doc_id long, text string")).withColumn("tag", F.lit(sequence.UNKNOWN))
        print(" ".join(f"{r.word}/{r.pred}" for r in model.tag(tokens).orderBy("tok_idx").collect()))


def _corpus(spark: SparkSession, path: str, maxlines: int) -> tuple[DataFrame, DataFrame]:
    rows = readers.read_bow(spark, path, maxlines).persist()
    return readers.bow_long(rows).withColumn("freq", F.col("freq").cast("long")), vocab.encode_labels(rows.select("doc_id", "label")).select("doc_id", "y")


def _shifted(bow: DataFrame, by: int) -> DataFrame:
    return bow.withColumn("doc_id", F.col("doc_id") + by)


def _cross_language_model(spark: SparkSession, args: argparse.Namespace) -> tuple[clscl.Model, DataFrame, DataFrame]:
    source, labels = _corpus(spark, args.source, args.maxlines)
    free_s, free_t = _corpus(spark, args.source_unlabelled, args.maxlines)[0], _corpus(spark, args.target_unlabelled, args.maxlines)[0]
    model = clscl.train(spark, source, labels, _shifted(free_s, 10**9), _shifted(free_t, 2 * 10**9), readers.read_dictionary(spark, args.dictionary), args.m, args.phi, args.k, args.reg, args.alpha, args.visits)
    return model, source, labels


def _scored(spark: SparkSession, model: clscl.Model, source: DataFrame, labels: DataFrame, args: argparse.Namespace) -> None:
    test, test_labels = _corpus(spark, args.target_test, -1)
    r = stats.repetitions(clscl.evaluate(spark, model, source, labels, test, test_labels, args.repetitions, args.lambda_, args.visits)).first()
    print(f"ACC: {r.mean:.2f} ({r['std']:.2f})")


def clscl_train(spark: SparkSession, args: argparse.Namespace) -> None:
    """Learns a cross-language model and saves it."""
    _cross_language_model(spark, args)[0].save(args.model)


def clscl_predict(spark: SparkSession, args: argparse.Namespace) -> None:
    """Trains on source data with a saved model, tests on target data, prints the mean and the deviation of the accuracy."""
    source, labels = _corpus(spark, args.source, -1)
    _scored(spark, clscl.Model.load(spark, args.model), source, labels, args)


def cross_language(spark: SparkSession, args: argparse.Namespace) -> None:
    """Learns a model, trains on source data, tests on target data, prints the mean and the deviation of the accuracy."""
    _scored(spark, *_cross_language_model(spark, args), args)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-v", "--verbose", action="store_true", help="log how long the steps take")
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *files: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=(run.__doc__ or name).split("\n")[0])
        c.set_defaults(run=run)
        for f in files:
            c.add_argument(f)
        return c

    def tagging(c: argparse.ArgumentParser) -> None:
        c.add_argument("--lang", default="en")
        c.add_argument("--tags", default="", help="comma-separated; none: all")
        for name in ("clusters", "places", "orgs", "firstnames", "lastnames"):
            c.add_argument(f"--{name}")

    c = command("ner-train", ner_train, "train", "model")
    tagging(c)
    c.add_argument("-f", "--features", default="rr09")
    c.add_argument("--learner", choices=("svm", "perceptron", "batch"), default="svm")
    c.add_argument("--least", type=int, default=1)
    c.add_argument("-r", "--reg", type=float, default=1e-5)
    c.add_argument("-E", "--epochs", type=int, default=100)
    c.add_argument("--eph", action="store_true")
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--aso", help="a saved subspace whose features are added")
    c.add_argument("--also", action="append", default=[], help="a further file whose features are known")
    c.add_argument("--pos", default="", help="comma-separated beginnings of parts of speech whose tokens are counted")
    c = command("ner-predict", ner_predict, "model", "test", "output")
    tagging(c)
    c.add_argument("--raw", action="store_true")
    c.add_argument("--scope", choices=("document", "corpus"), default="corpus")
    c = command("ner-aso", ner_aso, "train", "model")
    tagging(c)
    c.add_argument("--raw", action="store_true")
    c.add_argument("-m", "--tasks", type=int, default=1000)
    c.add_argument("-k", "--dims", type=int, default=50)
    c.add_argument("--least", type=int, default=2)
    c.add_argument("--visits", type=float, default=1e6)
    c.add_argument("--pos", default="", help="comma-separated beginnings of parts of speech whose tokens are used")
    c.add_argument("--fewer", action="store_true", help="go on where a place has fewer words")
    c.add_argument("--list", action="store_true", help="show the auxiliary tasks only")
    c = command("ner-demo", ner_demo, "model")
    tagging(c)
    learning = (("--phi", int, 30), ("-m", int, 450), ("-k", int, 100), ("--reg", float, 1e-5), ("--alpha", float, 0.85), ("--maxlines", int, -1))
    for name, run, files, testing in (
        ("clscl-train", clscl_train, ("source", "source_unlabelled", "target_unlabelled", "dictionary", "model"), False),
        ("clscl-predict", clscl_predict, ("model", "source", "target_test"), True),
        ("cross-language", cross_language, ("source", "source_unlabelled", "target_unlabelled", "target_test", "dictionary"), True),
    ):
        c = command(name, run, *files)
        for flag, kind, default in learning if name != "clscl-predict" else ():
            c.add_argument(flag, type=kind, default=default)
        c.add_argument("--visits", type=float, default=1e6)
        if testing:
            c.add_argument("--repetitions", type=int, default=10)
            c.add_argument("--lambda", dest="lambda_", type=float, default=0.01)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(format="%(message)s")
    LOG.setLevel(logging.INFO if args.verbose else logging.WARNING)
    args.run(spark or local_session(), args)


if __name__ == "__main__":
    main()
