"""Command line: import, check, expand, relate, train."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from textloom.channel import Channel
from textloom.operators import corpus, expansion, relations
from textloom.plans import training
from textloom.session import local_session
from textloom.sources import inputs, runs

log = logging.getLogger("textloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__)
    p.add_argument("-b", dest="index", required=True, help="folder of the index")
    p.add_argument("-x", dest="xml", help="import: folder of XML files")
    p.add_argument("--xt", dest="tag", default="text", help="tag of a document")
    p.add_argument("--xl", dest="limit", help="limit of documents; L takes L - 1")
    p.add_argument("--xp", dest="preprocessor", help="preprocessor of texts")
    p.add_argument("-v", dest="verbose", action="store_true", help="progress to standard error")
    p.add_argument("-s", dest="sound", action="store_true", help="check the index")
    p.add_argument("-c", dest="config", help="expand a concept by a TOML configuration")
    p.add_argument("-r", dest="pairs", help="extract relations by a JSON file of pairs")
    p.add_argument("-t", dest="reference", help="train against a file of words")
    p.add_argument("--tstdin", action="store_true", help="read the seed words of the training from standard input")
    p.add_argument("--flat", action="store_true", help="import: elements hold escaped text only, so that large files can be split")
    p.add_argument("--tmopso", action="store_true", help="train by two objectives")
    p.add_argument("--to", dest="out", default="train_swarm", help="folder of the training log")
    p.add_argument("--tstate", help="folder for the state of each cycle, to go on from if the training was stopped")
    p.add_argument("--tnparticles", type=int, default=100)
    p.add_argument("--tniter", type=int, default=100)
    p.add_argument("--tnbwords", type=int, default=5)
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = local_session("textloom-cli")
    if a.xml:
        limit = corpus.parse_limit(a.limit)
        if a.flat:
            built = corpus.build(inputs.read_xml_rows(spark, a.xml, a.tag), a.preprocessor, limit, compat_limit=True)
        else:
            built = corpus.build(inputs.read_xml(spark, a.xml, a.tag, None if limit is None else max(limit - 1, 0)), a.preprocessor)
        built.save(a.index)
        saved = corpus.Corpus.load(spark, a.index)
        corpus.check_sound(saved.vocab, saved.postings)
        return
    channel = Channel(sys.stderr.write if a.verbose else None)
    c = corpus.Corpus.load(spark, a.index)
    counts = corpus.corpus_counts(c.sentences, c.postings).first()
    channel.send(", ".join(f"{counts[f'n_{n}']} {n}" for n in ("sentences", "words", "postings")))
    if a.sound:
        corpus.check_sound(c.vocab, c.postings)
    elif a.pairs:
        pairs = inputs.pairs_request(spark, Path(a.pairs).read_text())
        relations.check_known(c.postings, pairs)
        for row in relations.grouped(relations.relate(c.sentences, c.tokens, c.postings, pairs, channel, relations.bind_article(c.vocab))).orderBy("w1").toLocalIterator():
            print(json.dumps({row["w1"]: row["w2s"]}, ensure_ascii=False))
    elif a.config:
        terms, params = inputs.read_config(Path(a.config).read_text())
        seeds = spark.createDataFrame([(t,) for t in terms], "word string")
        for row in corpus.missing(seeds, c.vocab).collect():
            log.warning("not in the corpus: %s", row["word"])
        for row in expansion.expand_concept(c.postings, corpus.lookup(seeds, c.vocab), params).orderBy("word").toLocalIterator():
            print(row["word"])
    elif a.reference:
        reference = corpus.lookup(inputs.read_words(spark, a.reference), c.vocab)
        seeds = inputs.words_from(spark, None, c.vocab) if a.tstdin else training.sample_seeds(reference, a.tnbwords)
        options = training.TrainingOptions(a.tnparticles, a.tniter, a.tnbwords)
        out = (training.train_mopso if a.tmopso else training.train_pso)(spark, c.postings, seeds, reference, options, store=a.tstate)
        runs.append(runs.from_log(out.log, spark, 0, 0), a.out, reset=True)
        runs.full_log(out.log, spark).write.mode("overwrite").partitionBy("icycle").parquet(f"{a.out.rstrip('/')}.log")
        if out.replay is not None:
            for row in out.replay.orderBy("word").toLocalIterator():
                print(row["word"])


if __name__ == "__main__":
    main()
