"""Substring deduplication with an FM-index for each shard.

A window is a run of words (13 by default) of one document. Its anchor is the
least hash of its 5-word runs; equal windows have equal anchors, and neighbouring
windows mostly share theirs. In three rounds between blocks and shards (see blocks):

1. Blocks tell the shards their anchors; shards answer with those that occur
   elsewhere too, so that text without a counterpart is left out early.
2. Blocks send the passages around such anchors, each once, to the anchors'
   shards. A shard joins its passages to a text with borders, indexes it (suffix
   order, Burrows-Wheeler transform, wavelet matrix) and streams every passage
   through it: backward search gives each window the interval of its occurrences
   and the least document among them.
3. Blocks get those least documents and remove the words that are covered.

All windows of a hot anchor's passages would meet in one shard; beyond some count
they are sent one by one to shards of their own hashes, where equal ones are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldmill.llm.blocks import NO_ID, answer, ask, blocks_of, by_shard, pack_arrays, shards_for, spread, told, unpack_arrays
from foldmill.llm.common import U64, Words, gram_hashes, mix, scratch, shuffle_partitions, span_hashes, written
from foldmill.llm.fmindex import FMIndex, least_in

WINDOW, RUN = 13, 5
#: Windows (each counted once for a block) from which an anchor is hot.
HOT = 4000
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
OUT_DDL = "doc_id long, n_words long, n_removed long, kept string"


class Windows:
    """The windows of a block's texts: places of their first words, hashes and anchors."""

    def __init__(self, w: Words, size: int):
        run = min(RUN, size)
        h = w.hashes()
        self.at = np.flatnonzero(w.starts_of(size))
        self.hash = self.anchor = np.empty(0, U64)
        if len(self.at):
            self.hash = gram_hashes(h, size)[self.at]
            least = gram_hashes(h, run)
            left, reach = size - run + 1, 1
            while reach < left:
                step = min(reach, left - reach)
                least = np.minimum(least[: len(least) - step], least[step:])
                reach += step
            self.anchor = least[self.at]


def anchors_told(size: int, shards: int):
    def tell(ids: np.ndarray, w: Words) -> Iterator[tuple[int, bytes]]:
        x = Windows(w, size)
        distinct = np.unique(x.hash, return_index=True)[1]
        anchor, n = np.unique(x.anchor[distinct], return_counts=True)
        for shard, part in by_shard(spread(mix(anchor), shards)):
            yield shard, pack_arrays(anchor[part], np.minimum(n[part], 65535).astype(np.uint16))

    return tell


def anchors_answered(blocks: list[int], bodies: list[bytes]) -> list[tuple[int, bytes]]:
    got = [unpack_arrays(b, U64, np.uint16) for b in bodies]
    anchor, at, blocks_with = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True, return_counts=True)
    windows = np.bincount(at, np.concatenate([g[1] for g in got]))
    again, hot = blocks_with > 1, windows > HOT
    out, lo = [], 0
    for block, (own, _) in zip(blocks, got, strict=True):
        mine = at[lo : lo + len(own)]
        lo += len(own)
        mine = mine[again[mine] | hot[mine]]
        if len(mine):
            out.append((block, pack_arrays(anchor[mine], hot[mine])))
    return out


def passages(x: Windows, w: Words, known: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window (numbers) and route of each passage: runs of windows with one known anchor, single windows of hot ones."""
    number = np.minimum(np.searchsorted(known, x.anchor), max(0, len(known) - 1))
    use = known[number] == x.anchor if len(known) else np.zeros(len(x.at), bool)
    is_hot = use & hot[number] if len(known) else use
    joined = np.zeros(len(x.at), bool)
    joined[1:] = use[1:] & use[:-1] & (x.anchor[1:] == x.anchor[:-1]) & (x.at[1:] == x.at[:-1] + 1) & (w.row[x.at[1:]] == w.row[x.at[:-1]]) & ~is_hot[1:]
    first = np.flatnonzero(use & ~joined)
    follows = np.append(np.flatnonzero(~joined), len(x.at))
    last = follows[np.searchsorted(follows, first, "right")] - 1
    return first, last, np.where(is_hot[first], mix(x.hash[first] + U64(1)), mix(x.anchor[first]))


def local_anchors(x: Windows, w: Words) -> np.ndarray:
    """Anchors that two texts of the block have."""
    if not len(x.at):
        return x.anchor
    order = np.argsort(x.anchor, kind="stable")
    anchor, row = x.anchor[order], w.row[x.at][order]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(anchor)) - 1
    return anchor[first[row[first] != row[last]]]


def passages_told(size: int, shards: int):
    def run(block: int, ids: np.ndarray, w: Words, bodies: list[bytes]) -> pa.Table:
        x = Windows(w, size)
        got = [unpack_arrays(b, U64, np.bool_) for b in bodies]
        far = np.concatenate([g[0] for g in got] + [np.empty(0, U64)])
        flag = np.concatenate([g[1] for g in got] + [np.empty(0, bool)])
        known = np.unique(np.concatenate([far, local_anchors(x, w)]))
        hot = np.zeros(len(known), bool)
        hot[np.searchsorted(known, far)] = flag
        first, last, route = passages(x, w, known, hot)
        out: list[tuple[int, bytes]] = []
        if len(first):
            n = (last - first + size).astype(np.int64)
            text, start, end = w.joined()
            left, right = start[x.at[first]], end[x.at[last] + size - 1]
            same = span_hashes(np.frombuffer(text, np.uint8), left, right)
            doc = ids[w.row[x.at[first]]]
            kept, at = np.unique(same, return_index=True, return_inverse=True)[1:]
            low, high = np.full(len(kept), NO_ID), np.full(len(kept), np.iinfo(np.int64).min)
            np.minimum.at(low, at, doc)
            np.maximum.at(high, at, doc)
            for shard, part in by_shard(spread(route[kept], shards)):
                which = kept[part]
                words = b"\n".join(text[a:b] for a, b in zip(left[which].tolist(), right[which].tolist(), strict=True))
                out.append((shard, pack_arrays(low[part], high[part], n[which].astype(np.int32), np.frombuffer(words, np.uint8))))
        return pa.Table.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([block] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["key", "block", "body"])

    return run


def passages_answered(size: int):
    def run(blocks: list[int], bodies: list[bytes]) -> list[tuple[int, bytes]]:
        got = [unpack_arrays(b, np.int64, np.int64, np.int32, np.uint8) for b in bodies]
        number: dict[bytes, int] = {}
        mine = [np.array([number.setdefault(p, len(number)) for p in g[3].tobytes().split(b"\n")]) for g in got]
        every = np.concatenate(mine)
        low = np.full(len(number), NO_ID)
        np.minimum.at(low, every, np.concatenate([g[0] for g in got]))
        n = np.zeros(len(number), np.int64)
        n[every] = np.concatenate([g[2] for g in got])
        words = pa.array(b" ".join(number).split(b" "), pa.binary()).dictionary_encode()
        index = words.indices.to_numpy() + 1
        begin = np.cumsum(n + 1) - n
        text = np.zeros(int(n.sum() + len(n) + 1), np.int64)
        inside = np.ones(len(text), bool)
        inside[begin - 1] = inside[-1] = False
        text[inside] = index
        owner = np.repeat(np.arange(len(n)), n + 1)
        fm = FMIndex(text, len(words.dictionary) + 1, size)
        windows = n - size + 1
        first = np.cumsum(windows) - windows
        start = np.arange(windows.sum()) - np.repeat(first, windows) + np.repeat(begin, windows)
        a, b = fm.search(start, size)
        least = least_in(np.append(low[owner], NO_ID)[fm.order], a, b)
        w = Words(np.frombuffer(b" ".join(number), np.uint8), np.array([0, sum(map(len, number)) + len(number) - 1]))
        flat = np.cumsum(n) - n
        hashes = gram_hashes(w.hashes(), size)[start - np.repeat(begin - flat, windows)]
        out = []
        for block, own, g in zip(blocks, mine, got, strict=True):
            part = np.repeat(first[own], windows[own]) + np.arange(windows[own].sum()) - np.repeat(np.cumsum(windows[own]) - windows[own], windows[own])
            part = part[least[part] < np.repeat(g[1], windows[own])]
            if len(part):
                out.append((block, pack_arrays(hashes[part], least[part])))
        return out

    return run


def uncovered(size: int, ids: np.ndarray, w: Words, bodies: list[bytes]) -> np.ndarray:
    """Which words of a block no window covers that also starts in an earlier document."""
    x = Windows(w, size)
    got = [unpack_arrays(b, U64, np.int64) for b in bodies]
    covered = np.zeros(len(w.start) + 1, np.int64)
    if got and len(x.at):
        h, least = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        order = np.argsort(h, kind="stable")
        h, least = h[order], least[order]
        at = np.minimum(np.searchsorted(h, x.hash), len(h) - 1)
        doc = ids[w.row[x.at]]
        gone = x.at[(h[at] == x.hash) & (least[at] < doc) & ~w.no_id[w.row[x.at]]]
        np.add.at(covered, gone, 1)
        np.add.at(covered, gone + size, -1)
    return np.cumsum(covered)[:-1] == 0


def intervals(size: int):
    def run(block: int, ids: np.ndarray, w: Words, bodies: list[bytes]) -> pa.Table:
        gone = ~uncovered(size, ids, w, bodies)
        new, last = gone.copy(), gone.copy()
        new[1:] &= ~gone[:-1] | (w.row[1:] != w.row[:-1])
        last[:-1] &= ~gone[1:] | (w.row[1:] != w.row[:-1])
        first, end = np.flatnonzero(new), np.flatnonzero(last) + 1
        return pa.Table.from_arrays([pa.array(ids[w.row[first]]), pa.array(first - w.first[w.row[first]]), pa.array(end - first)], names=["doc_id", "start", "length"])

    return run


def removed(size: int):
    def run(block: int, ids: np.ndarray, w: Words, bodies: list[bytes]) -> pa.Table:
        keep = uncovered(size, ids, w, bodies)
        text, start, end = w.joined()
        kept = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if a == b:
                kept.append("")
            elif keep[a:b].all():
                kept.append(text[start[a] : end[b - 1]].decode("utf-8", "replace"))
            else:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], keep[a:b], [False]]).astype(np.int8))) + a
                kept.append(b" ".join(text[start[i] : end[j - 1]] for i, j in edge.reshape(-1, 2).tolist()).decode("utf-8", "replace"))
        gone = np.bincount(w.row[~keep], minlength=len(ids))
        return pa.Table.from_arrays([pa.array(ids, mask=w.no_id), pa.array(w.count), pa.array(gone), pa.array(kept, pa.string())], schema=OUT)

    return run


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs; kept joins the words that stay by one space.

    A word goes if a window that covers it also starts in a document with a smaller
    doc_id, judged on the input. Null and empty texts have no words; texts shorter
    than a window stay whole. A row with a null doc_id is no document's
    predecessor and stays whole. Rows with one doc_id don't remove each
    other. A very long text is a block of its own and is taken whole; other columns
    are not read, whatever their names. An empty table gives an empty one.
    """
    blocks, found = matches(docs, size)
    return told(blocks, found, removed(size), OUT_DDL)


def repeated_intervals(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, start, length): each longest run of words, counted from 0, that ``remove_repeats`` takes out of a document.

    The matching statistic of a word is the length of the longest run that starts with it
    and also occurs in an earlier document; these are the intervals where it reaches ``size``, with the words that it reaches over.
    """
    blocks, found = matches(docs, size)
    return told(blocks, found, intervals(size), "doc_id long, start long, length long")


def matches(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of docs, and for each block its windows that start in an earlier document, with the least of these."""
    spark = docs.sparkSession
    blocks = blocks_of(docs)
    shards = shards_for(blocks)
    parts = max(shuffle_partitions(spark), shards // 4)
    with scratch(spark):
        again = written(answer(ask(blocks, anchors_told(size, shards)), anchors_answered, parts))
        sent = told(blocks, again, passages_told(size, shards), "key long, block long, body binary")
        return blocks, written(answer(sent, passages_answered(size), parts), keep=True)
