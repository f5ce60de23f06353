"""Substring deduplication on words by repeated-phrase automata.

Candidate passages are routed to shards by their anchors (see ``anchors``). In a shard, windows that may recur are found by counting
hashes; windows that follow each other wherever they occur are one passage. Each different passage is compiled once, as word numbers, into the shard's
Aho-Corasick automaton, and the segments of all documents are streamed through it. What it finds decides: a passage
counts as recurring if its very words occur twice or more, and every place where they occur is covered. Hashes only propose; a passage that two
hashes proposed wrongly is found once, and is looked for again window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .anchors import Windows, repeated_spans, without_spans
from .common import U64, mixed, powers, prefix_hash

GRAM = 10


def run_hashes(codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words from each place on."""
    h = prefix_hash(mixed(codes.astype(np.uint64) + U64(1)))
    return mixed((h[at + length] - h[at]) * powers(len(codes))[1][at])


def proposed(coded: list[np.ndarray], anchors: list[int], copies: list[int], window: int) -> list[tuple[int, int, int]]:
    """(segment, first word, end) of passages whose windows have hashes that occur at least twice in the segments of their anchor.

    Two windows side by side are in one passage if both, and the run of one more word that both make, have the same count: then they occur together only.
    """
    size = np.array([len(c) for c in coded])
    n = size - window + 1
    segment = np.repeat(np.arange(len(coded)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(size) - size, n) + place
    codes, weight = np.concatenate(coded), np.array(copies, np.float64)[segment]
    group = mixed(np.array(anchors, np.int64).view(np.uint64))[segment]

    def counted(hashes: np.ndarray, w: np.ndarray) -> np.ndarray:
        _, number = np.unique(hashes, return_inverse=True)
        return np.bincount(number, w)[number]

    count = counted(run_hashes(codes, at, window) ^ group, weight)
    both = np.flatnonzero(segment[1:] == segment[:-1])
    pair = np.zeros(max(0, len(segment) - 1))
    pair[both] = counted(run_hashes(codes, at[both], window + 1) ^ group[both], weight[both])
    again = count > 1
    tied = (pair == count[:-1]) & (pair == count[1:]) & again[1:] & again[:-1]
    first = np.flatnonzero(again & ~np.concatenate([[False], tied]))
    last = np.flatnonzero(again & ~np.concatenate([tied, [False]]))
    return list(zip(segment[first].tolist(), place[first].tolist(), (place[last] + window).tolist(), strict=True))


def occurrences(passages: dict[tuple, int], coded: list[np.ndarray], copies: list[int]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """How often each passage's words occur, and (segment, first word, end, passage) of every place, by one automaton."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    length = {}
    for passage, number in passages.items():
        automaton.add_word(passage, number)
        length[number] = len(passage)
    automaton.make_automaton()
    count, places = np.zeros(len(passages), np.int64), []
    for i, code in enumerate(coded):
        for end, number in automaton.iter(tuple(code.tolist())):
            count[number] += copies[i]
            places.append((i, end - length[number] + 1, end + 1, number))
    return count, places


def find_phrases(window: int):
    """Finder for ``repeated_spans``: covered word ranges of segments by an automaton of their recurring passages."""
    def finder(anchors: list[int], copies: list[int], segments: list[bytes], counts: list[int]) -> Iterator[tuple[int, int, int]]:
        numbers: dict[bytes, int] = {}
        coded = [np.array([numbers.setdefault(x, len(numbers)) for x in s.split(b" ")], np.int64) for s in segments]
        passages: dict[tuple, int] = {}
        for i, lo, hi in proposed(coded, anchors, copies, window):
            passages.setdefault(tuple(coded[i][lo:hi].tolist()), len(passages))
        covered: dict[int, np.ndarray] = {}
        while passages:
            count, places = occurrences(passages, coded, copies)
            for i, lo, hi, number in places:
                if count[number] > 1:
                    mark = covered.setdefault(i, np.zeros(len(coded[i]) + 1, np.int64))
                    mark[lo] += 1
                    mark[hi] -= 1
            alone = [p for p, number in passages.items() if count[number] < 2 and len(p) > window]
            passages = {w: k for k, w in enumerate(dict.fromkeys(p[j:j + window] for p in alone for j in range(len(p) - window + 1)))}
        for i, mark in covered.items():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(mark) > 0).astype(np.int8), [0]])))
            for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                yield i, lo, hi

    return finder


def repeated_phrases(docs: DataFrame, text: str = "text", window: int = 35, most_segments: int = 5_000) -> DataFrame:
    """(row, parts): word ranges of each document covered by ``window``-word sequences that also start elsewhere."""
    if window < GRAM + 1:
        raise ValueError(f"windows have more than {GRAM} words")
    return repeated_spans(docs, text, Windows("words", window, GRAM, most_segments), find_phrases(window))


def remove_phrases(docs: DataFrame, text: str = "text", window: int = 35, most_segments: int = 5_000) -> DataFrame:
    """``docs`` with ``kept`` (the words left, joined by one space) and ``spans`` (word ranges removed).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Every word covered by ``window`` consecutive words of the document
    that also start anywhere else, in this document or another, is removed; windows are judged on the input. A null or
    blank text has no words; shorter texts are kept; equal rows count as different documents. Columns
    named ``kept`` or ``spans`` are replaced, others stay. An empty table gives no rows.
    """
    def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
        words = raw.split()
        out, at = [], 0
        for a, b in spans:
            out += words[at:a]
            at = b
        return b" ".join([*out, *words[at:]])

    return without_spans(docs, text, repeated_phrases(docs, text, window, most_segments), cut, "string")
