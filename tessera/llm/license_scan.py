"""License scans by a positional index of licence words.

Templates are short licence notices with key phrases; base phrases are templates whose words are all key words.  The
index maps each licence word to its postings (template, place in the template).

1. One scan of the corpus counts the documents that hold each licence word; a word's IDF is log10 of the number of
   documents over that count, in whole millionths.  Only these counts (one for each word of the templates) meet.
2. A template's anchors are its `ANCHORS` key words of highest IDF.  A second scan looks a file's licence words up,
   highest IDF first; a posting at place q of a template proposes that the template starts at place - q.  Only starts
   that all anchors of the template agree on go on.
3. There all key phrases are verified word by word.  A template is found where all of them stand at their places; its
   score there is the share of the IDF of its words that stand at theirs, and a document's score is the best.

A template can't be found without its anchors, so the index loses nothing: every place is reported, however many.

Defined cases: a null or empty text has no words, labels or places and scores 0; repeated rows are each reported; null
ids stay null; a template may stand anywhere and any number of times; other columns are left behind; an empty table
gives no rows.  A corpus whose every document holds all words of a template gives them IDF 0: such words count as
1 millionth, so that scores stay defined.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import own_names, small_batches
from .text import KeyTable, Words, batches


@dataclass(frozen=True)
class Template:
    """A licence notice (words as they are after lower-casing) and its key phrases, each once in the notice."""

    label: str
    words: str
    keys: tuple[str, ...]


#: The base phrases and their labels.
BASE = [
    Template("cc-by", "cc by", ("cc by",)),
    Template("gpl", "general public license", ("general public license",)),
    Template("reserved", "all rights reserved", ("all rights reserved",)),
]

#: Notices of well-known licences.
NOTICES = [
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright and related",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
]

ANCHORS = 2


def hashed(words: Sequence[str]) -> np.ndarray:
    w = Words(pa.array([" ".join(words)]), alnum=True)
    return w.hashes()


def key_places(t: Template) -> list[int]:
    """The places of the template's key words."""
    words = t.words.split()
    out: set[int] = set()
    for key in t.keys:
        k = key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        out |= set(range(at, at + len(k)))
    return sorted(out)


def word_weights(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """The IDF of each word in millionths, over all rows of `docs` (text)."""
    keys = hashed(vocabulary)
    table = docs.sparkSession.sparkContext.broadcast(KeyTable(keys))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys) + 1, np.int64)
        for batch in batches(stream, "text"):
            w = Words(batch.column(0), lower=True, alnum=True)
            at, word = table.value.find(w.hashes())
            doc = np.searchsorted(w.first, at, side="right") - 1
            total[:-1] += np.bincount(np.unique(doc * len(keys) + word) % len(keys), minlength=len(keys))
            total[-1] += w.n_docs
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["word", "n"])

    sums = dict(docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n")).collect())  # a row for each word of the templates
    order = np.argsort(keys)
    n = sums.get(len(keys), 0)
    held = {vocabulary[int(i)]: sums.get(j, 0) for j, i in enumerate(order)}
    return {w: max(1, int(np.floor(np.log10((n + 1) / (c + 1)) * 1_000_000 + 0.5))) for w, c in held.items()}


class Index:
    """The positional index of the templates, with each template's anchors and key places."""

    def __init__(self, templates: Sequence[Template], weights: dict[str, int]) -> None:
        self.templates = list(templates)
        self.words = sorted(weights)
        self.table = KeyTable(hashed(self.words))
        place_of = {w: i for i, w in enumerate(np.array(self.words)[np.argsort(hashed(self.words))].tolist())}
        self.weight = np.array([weights[w] for w in place_of], np.int64)
        self.members = [np.array([place_of[w] for w in t.words.split()]) for t in templates]
        self.keys = [np.array(key_places(t)) for t in templates]
        self.anchors = []
        for own, key in zip(self.members, self.keys):
            rarest = sorted(key.tolist(), key=lambda q: (-self.weight[own[q]], q))
            self.anchors.append(rarest[:ANCHORS])

    def find(self, w: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each template: (document, start in words of the document, score in millionths) of its occurrences."""
        at, word = self.table.find(w.hashes())
        here = np.full(len(w.starts), -1, np.int64)
        here[at] = word
        by_word = np.argsort(word, kind="stable")
        edges = np.searchsorted(word[by_word], np.arange(len(self.words) + 1))
        out = []
        for own, keys, anchors in zip(self.members, self.keys, self.anchors):
            starts = None
            for q in anchors:
                posting = at[by_word[edges[own[q]] : edges[own[q] + 1]]] - q
                starts = posting if starts is None else starts[np.isin(starts, posting, assume_unique=True)]
                if not len(starts):
                    break
            # all key words stand in one document
            starts = starts[(starts + keys[0] >= 0) & (starts + keys[-1] < len(here))]
            doc = np.searchsorted(w.first, starts + keys[0], side="right") - 1
            fits = w.first[doc + 1] > starts + keys[-1] if len(starts) else np.zeros(0, bool)
            for q in keys:
                fits[fits] = here[starts[fits] + q] == own[q]
            starts, doc = starts[fits], doc[fits]
            score = np.zeros(len(starts), np.int64)
            for q, x in enumerate(own):
                place = starts + q
                inside = (place >= w.first[doc]) & (place < w.first[doc + 1])
                score[inside] += np.where(here[place[inside]] == x, self.weight[x], 0)
            out.append((doc, starts - w.first[doc], score * 1_000_000 // self.weight[own].sum()))
        return out


def license_scan(docs: DataFrame, base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES) -> DataFrame:
    """doc_id, n_words, places array<struct<label, start, score>> (all, by start and label), n_base, first_word,
    last_word, base_labels, labels (arrays, sorted), score, for every row."""
    spark = small_batches(docs.sparkSession)
    docs = own_names(docs, {"doc_id": "long", "text": "string"})
    templates = [*base, *notices]
    weights = word_weights(docs, sorted({w for t in templates for w in t.words.split()}))
    index = spark.sparkContext.broadcast(Index(templates, weights))
    n_base = len(base)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            w = Words(batch.column(1), lower=True, alnum=True)
            found = index.value.find(w)
            kind = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            doc, start, score = (np.concatenate([x[i] for x in found]).astype(np.int64) for i in range(3))
            by = np.lexsort((kind, start, doc))
            kind, doc, start, score = kind[by], doc[by], start[by], score[by]
            edges = pa.array(np.searchsorted(doc, np.arange(w.n_docs + 1)).astype(np.int32))
            label = pa.array([t.label for t in index.value.templates]).take(pa.array(kind))
            places = pa.StructArray.from_arrays([label, pa.array(start), pa.array(score), pa.array(kind < n_base)], ["label", "start", "score", "base"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(edges, places)], ["doc_id", "n_words", "places"])

    rows = docs.mapInArrow(run, "doc_id long, n_words long, places array<struct<label: string, start: long, score: long, base: boolean>>")
    own = F.filter("places", lambda x: x["base"])
    rows = rows.withColumn("own", own)
    return rows.select(
        "doc_id", "n_words", "places", F.size("own").cast("long").alias("n_base"), F.array_min("own.start").alias("first_word"), F.array_max("own.start").alias("last_word"),
        F.array_sort(F.array_distinct("own.label")).alias("base_labels"), F.array_sort(F.array_distinct("places.label")).alias("labels"),
        (F.coalesce(F.array_max("places.score"), F.lit(0)) / 1_000_000).alias("score"),
    )
