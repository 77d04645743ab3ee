"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton over the words of all normalised items is built once on the driver
and sent to the executors. Each text is streamed through it: at every word the
longest suffix of the text so far that occurs in some item is known, and where
its length reaches the window (or a whole item shorter than the window ends)
those words are hit. A vectorised screen first finds the runs of words whose
neighbours all stand side by side in some item; outside such runs no window can
lie, so only the runs are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import ALNUM, LOWER, frugal, ngrams, span_hashes, text_slices, words

WINDOW = 13
#: The items are a test set held on the driver: at most so many bytes of text, checked before they are collected.
MOST_BYTES = 64 << 20


class SuffixAutomaton:
    """All substrings (runs of words) of several items, and for each which items hold it."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[set[int]] = [set()]
        self.whole: list[list[tuple[int, int]]] = [[]]
        self.sequences: list[list[bytes]] = []

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.whole.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state for the strings that p followed by word reaches; cut off from q where q also holds longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[bytes]) -> None:
        last = 0
        for word in sequence:
            if word in self.next[last]:
                last = self._split(last, self.next[last][word], word)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p != -1 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p != -1:
                self.link[new] = self._split(p, self.next[p][word], word)
            last = new
        self.sequences.append(sequence)

    def close(self) -> SuffixAutomaton:
        """Note for each state the items whose windows it stands for, and the short items that end there."""
        for number, sequence in enumerate(self.sequences):
            state = 0
            for word in sequence:
                state = self.next[state][word]
                up = state
                while up > 0 and number not in self.items[up]:
                    self.items[up].add(number)
                    up = self.link[up]
            if 0 < len(sequence) < self.window:
                self.whole[state].append((len(sequence), number))
        # The nearest ancestor (or the state itself) in which some short item ends.
        self.short = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[state] = state if self.whole[state] else self.short[self.link[state]]
        return self

    def scan(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (first word, word after the last) in a run of words, and the numbers of the items that hit."""
        spans, found = [], set()
        state = size = 0
        for j, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word not in self.next[state]:
                continue
            state, size = self.next[state][word], size + 1
            if size >= self.window:
                top = state
                while self.length[self.link[top]] >= self.window:
                    top = self.link[top]
                found |= self.items[top]
                spans.append((j + 1 - self.window, j + 1))
            up = self.short[state]
            while up:
                for length, number in self.whole[up]:
                    if length <= size:
                        found.add(number)
                        spans.append((j + 1 - length, j + 1))
                up = self.short[self.link[up]]
        return spans, found


def _item_words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    return [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


class Screen:
    """The automaton with the hashes that tell where it must be run."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.names = [str(name) for name, _ in items]
        self.automaton = SuffixAutomaton(window)
        pairs, singles, shortest = [], [], window
        for _, text in items:
            sequence = _item_words(text)
            self.automaton.add(sequence)
            if sequence:
                data = np.frombuffer(b" ".join(sequence), np.uint8)
                starts, ends, first = words(data, np.array([0, len(data)]))
                h = span_hashes(data, starts, ends)
                pairs.append(ngrams(h, first, 2)[1])
                shortest = min(shortest, max(2, len(sequence)))
                if len(sequence) == 1:
                    singles.append(h)
        self.automaton.close()
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.singles = np.unique(np.concatenate(singles)) if singles else np.zeros(0, np.uint64)
        self.shortest = shortest
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.pairs & np.uint64(0xFFFF)] = True

    def runs(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (first word, word after the last) of the runs in which a window can lie."""
        at, g = ngrams(h, first, 2)
        near = self.maybe[g & np.uint64(0xFFFF)]
        at, g = at[near], g[near]
        inside = np.zeros(len(h) + 1, bool)
        if len(g):
            where = np.minimum(np.searchsorted(self.pairs, g), len(self.pairs) - 1)
            inside[at[self.pairs[where] == g]] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
        runs = np.stack([edge[::2], edge[1::2] + 1], 1)
        runs = runs[runs[:, 1] - runs[:, 0] >= self.shortest]
        if len(self.singles):
            alone = np.flatnonzero(np.isin(h, self.singles))
            runs = np.concatenate([runs, np.stack([alone, alone + 1], 1)])
        return runs


def _outside(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; white space that met on both sides of one becomes one piece."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a].rstrip(b" ") if out or at < a else b"")
        at = b
    out.append(text[at:])
    return b" ".join(x for x in (p.strip(b" ") for p in out) if x).decode()


def overlaps(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, least_percent: int = 5, clean: bool = False,
) -> DataFrame:
    """Per document: id, n_words, n_hit, items (ids as sorted strings), contaminated; with ``clean`` also clean_text.

    Words are runs of digits, letters a-z after lower-casing A-Z, and characters
    outside ASCII. A window is ``window`` consecutive words of an item; an item of
    fewer words, but not none, is one window. Words inside any occurrence of a
    window are hit; a document is contaminated if it has a hit and at least
    ``least_percent`` percent of its words are hit. clean_text is the text without
    the hit spans. Null or empty texts have no words and no hits; items without
    words match nothing; rows that repeat an id are each judged. Other columns are
    ignored. The items are collected after their size was checked (MOST_BYTES).
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text_col)), F.lit(0))).first()[0]
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of benchmark text; at most {MOST_BYTES} are held in memory: judge it in parts")
    items = [tuple(r) for r in benchmark.select(F.col(item_col).cast("string"), item_text_col).collect()]
    screen = documents.sparkSession.sparkContext.broadcast(Screen(items, window))
    fields = [pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("items", pa.list_(pa.string())), pa.field("contaminated", pa.bool_())]
    fields += [pa.field("clean_text", pa.string())] * clean

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = screen.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for row, end, raw, off in text_slices(texts):
                data = LOWER[raw]
                starts, ends, first = words(data, off, ALNUM)
                n = np.diff(first)
                hit, found = np.zeros(len(starts), bool), [set() for _ in n]
                if len(starts):
                    for a, b in s.runs(span_hashes(data, starts, ends), first):
                        spans, numbers = s.automaton.scan([data[x:y].tobytes() for x, y in zip(starts[a:b], ends[a:b], strict=True)])
                        if spans:
                            found[np.searchsorted(first, a, "right") - 1] |= numbers
                            for x, y in spans:
                                hit[a + x : a + y] = True
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_hit = sums[first[1:]] - sums[first[:-1]]
                out = [
                    ids.slice(row, end - row), pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([sorted({s.names[k] for k in x}) for x in found], pa.list_(pa.string())), pa.array((n_hit > 0) & (100 * n_hit >= least_percent * n)),
                ]
                if clean:
                    kept = []
                    for k in range(len(n)):
                        if not n_hit[k]:
                            kept.append(texts[row + k].as_py())
                            continue
                        mask = np.concatenate([[0], hit[first[k] : first[k + 1]].astype(np.int8), [0]])
                        edge = np.flatnonzero(np.diff(mask))
                        kept.append(_outside(raw[off[k] : off[k + 1]].tobytes(), [(int(starts[first[k] + x] - off[k]), int(ends[first[k] + y - 1] - off[k])) for x, y in zip(edge[::2], edge[1::2], strict=True)]))
                    out.append(pa.array(kept, pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[batch.schema.names[0], *(f.name for f in fields)])

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, n_hit bigint, items array<string>, contaminated boolean" + ", clean_text string" * clean
    return documents.select(id_col, text_col).mapInArrow(frugal(judge), schema)


def digest_items(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_items and the SHA-256 of the comma-joined item ids in place of the list."""
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def item_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules: object) -> DataFrame:
    """The documents without contaminated ones; from the rest, which stay, hit spans are cut out of the text. All columns stay.

    The text of a document without hits stays byte for byte as it was, null included.
    """
    names = documents.columns
    keyed = documents.withColumn("__row", F.struct(*names)).select("__row", F.col(text_col))
    judged = overlaps(keyed, benchmark, id_col="__row", text_col=text_col, clean=True, **rules)
    kept = judged.where(~F.col("contaminated"))
    return kept.select(*[F.col("clean_text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in names])
