"""Licence texts in documents: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col
from plumbline.llm.common import blocks, text_rows
from plumbline.llm.contamination import normal_words
from plumbline.llm.words import hash_grams

# Notices by licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}

#: Words of a fingerprint, fingerprints per winnowing window, half the band of the alignment, and the
#: share of a template's words that must be matched.
GRAM, WINDOW, BAND, LEAST_COVERAGE = 3, 2, 8, 0.8

MATCHES = "array<struct<template:string,start:int,stop:int,matched:int,coverage:double>>"


class Templates(NamedTuple):
    names: list[str]
    words: list[np.ndarray]  # hashes
    prints: np.ndarray  # sorted fingerprints, and of each
    owner: np.ndarray  # its template
    place: np.ndarray  # and word


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest gram of every window of neighbours, the rightmost of equal ones."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(runs)) + window - 1 - np.argmin(runs[:, ::-1], axis=1))


def index_templates(templates: dict[str, str]) -> Templates:
    """The inverted index of winnowed fingerprints; templates of fewer than GRAM words are left out."""
    names, words, prints, owner, place = [], [], [], [], []
    for name, text in sorted(templates.items()):
        hashes = normal_words(pa.array([text]))[0]
        if len(hashes) < GRAM:
            continue
        grams = hash_grams(hashes, GRAM)
        kept = winnow(grams)
        prints.append(grams[kept])
        owner.append(np.full(len(kept), len(names)))
        place.append(kept)
        names.append(name)
        words.append(hashes)
    if not names:
        return Templates([], [], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    prints, owner, place = (np.concatenate(x) for x in (prints, owner, place))
    order = np.argsort(prints, kind="stable")
    return Templates(names, words, prints[order], owner[order], place[order])


def align(template: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Most words matched in order, and first and last place in `text`, within BAND of the diagonal.

    `text` begins BAND words before the place where the template would begin.
    """
    width = 2 * BAND + 1
    # Per place of the band: words matched, and minus the first place (later starts win ties), last place.
    best = [(0, 0, -1)] * (width + 1)
    for i, word in enumerate(template.tolist()):
        row = [(0, 0, -1)] * (width + 1)
        for b in range(width):
            j = i + b
            # The diagonal step, the step down the template, the step along the text.
            old = best[b]
            choice = max(best[b + 1], row[b - 1] if b else (0, 0, -1))
            if j < len(text) and int(text[j]) == word:
                choice = max(choice, (old[0] + 1, old[1] if old[0] else -j, j))
            row[b] = choice
        best = row
    matched, start, stop = max(best)
    return matched, -start, stop + 1


def find_templates(index: Templates, hashes: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """Per text, the template places that reach LEAST_COVERAGE; of overlapping ones of a template, the best."""
    out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    if not index.names or len(hashes) < GRAM:
        return out
    grams = hash_grams(hashes, GRAM)
    low, high = np.searchsorted(index.prints, grams, "left"), np.searchsorted(index.prints, grams, "right")
    hit = np.flatnonzero(high > low)
    text = np.searchsorted(first, hit, side="right") - 1
    inside = hit + GRAM <= first[text + 1]
    seen: set[tuple[int, int, int]] = set()
    for at, t in zip(hit[inside].tolist(), text[inside].tolist()):
        for k in range(low[at], high[at]):
            owner = int(index.owner[k])
            begin = at - int(first[t]) - int(index.place[k])
            # Hits of one place lie within half a band of each other.
            cell = (t, owner, begin // (BAND // 2))
            if cell in seen or (*cell[:2], cell[2] - 1) in seen:
                continue
            seen.add(cell)
            words = index.words[owner]
            start = int(first[t]) + begin - BAND
            part = hashes[max(start, int(first[t])) : min(start + len(words) + 2 * BAND, int(first[t + 1]))]
            shift = max(start, int(first[t])) - start
            padded = np.concatenate([np.zeros(shift, np.uint64), part])
            matched, a, b = align(words, padded)
            if matched >= LEAST_COVERAGE * len(words):
                place = start - int(first[t])
                out[t].append({"template": index.names[owner], "start": place + a, "stop": place + b, "matched": matched, "coverage": matched / len(words)})
    return [_distinct(found) for found in out]


def _distinct(found: list[dict]) -> list[dict]:
    kept: list[dict] = []
    for m in sorted(found, key=lambda m: (-m["matched"], m["start"], m["template"])):
        if not any(k["template"] == m["template"] and k["start"] < m["stop"] and m["start"] < k["stop"] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m["start"], m["template"]))


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", keep: list[str] | None = None, name: str = "licenses"
) -> DataFrame:
    """The columns `keep` of `docs` (all if None) with the array `name`: the licence templates each text holds.

    Every run of GRAM words of every whole text is looked up among the templates' winnowed fingerprints;
    each place found is aligned with the whole template, word by word, in a band of BAND words to
    either side. Templates whose words are matched to LEAST_COVERAGE are reported with the first word,
    the word behind the last, the words matched and their share. Words are compared in lower case
    without marks. Rows are judged where they lie; the templates are an argument of the call and travel
    with the tasks. Missing and empty texts, and all texts without templates, hold none.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    rows, at = text_rows(docs, kept, text)
    shared = docs.sparkSession.sparkContext.broadcast(index_templates(templates))
    schema = rows.select(*map(col, kept), F.lit(None).cast(MATCHES).alias(name)).schema
    kind = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("matched", pa.int32()), ("coverage", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, batch.schema.names[at]):
                found = find_templates(shared.value, *normal_words(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(found, kind)], names=[*kept, name])

    return rows.mapInArrow(scan, schema)
