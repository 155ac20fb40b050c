"""Token counts of a unigram vocabulary by a Viterbi pass that keeps no path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kurzwerk.llm.common import map_batches, slices
from kurzwerk.llm.word_pieces import coded_words

#: What the tokenizer library takes off the lowest score for a character
#: without a piece, and the mark it puts for a blank and in front of a text.
UNKNOWN_PENALTY = 10.0
MARK = "▁"
CACHE_WORDS = 400_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter:
    """Pieces of the best segmentation, with the tie rules of the tokenizer library.

    All matches of the vocabulary come from one Aho-Corasick pass. Of equally good
    segmentations of a prefix the one with the longest last piece wins: matches that
    end at one place are tried from the longest, and only a better score replaces.
    A character without a piece of its own is tried last, at the lowest score less a
    penalty. Neighbouring unknown characters are one stretch; it counts its bytes if
    the vocabulary has a piece for each, else one.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.scores = dict(pieces)
        for piece, score in self.scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in self.scores}
        self.memory: dict[str, int] = {}

    def unknown_pieces(self, stretch: str) -> int:
        raw = stretch.encode("utf-8")
        return len(raw) if self.bytes.issuperset(raw) else 1

    def count(self, word: str) -> int:
        """Number of pieces of one word (with its mark)."""
        if word in self.scores and len(word) == 1:
            return 1
        n = len(word)
        # Per end: score, pieces before the open unknown stretch, where that began.
        score: list[float | None] = [None] * (n + 1)
        pieces = [0] * (n + 1)
        open_at = [-1] * (n + 1)
        score[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, found in self.automaton.iter(word):
            ends[last + 1].append(found)
        for end in range(1, n + 1):
            best = None
            chosen = 0
            single = False
            for size, value in ends[end]:
                single |= size == 1
                before = score[end - size]
                if before is not None and (best is None or before + value > best):
                    best, chosen = before + value, size
            before = score[end - 1]
            if not single and before is not None:
                if best is None or before + self.unknown > best:
                    best, chosen = before + self.unknown, 0
            score[end] = best
            if chosen:
                begin = end - chosen
                pieces[end] = 1 + pieces[begin]
                if open_at[begin] >= 0:
                    pieces[end] += self.unknown_pieces(word[open_at[begin] : begin])
            else:
                begin = end - 1
                pieces[end] = pieces[begin]
                open_at[end] = open_at[begin] if open_at[begin] >= 0 else begin
        if open_at[n] >= 0:
            return pieces[n] + self.unknown_pieces(word[open_at[n] :])
        return pieces[n]

    def count_run(self, run: str) -> int:
        """Pieces of a stretch of text whose blanks are marks already."""
        total = 0
        at = 0
        while at < len(run):
            stop = run.find(MARK, at + 1)
            stop = len(run) if stop < 0 else stop
            total += self.count(run[at:stop])
            at = stop
        return total

    def counts(self, words: list[str]) -> np.ndarray:
        if len(self.memory) + len(words) > CACHE_WORDS:
            self.memory.clear()
        memory, out = self.memory, np.empty(len(words), np.int64)
        for k, word in enumerate(words):
            n = memory.get(word)
            if n is None:
                n = memory[word] = self.count_run(word)
            out[k] = n
        return out


#: Counters of this process, by file.
LOADED: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    if path not in LOADED:
        LOADED[path] = Counter(load_pieces(path))
    return LOADED[path]


def row_counts(counter: Counter, texts: pa.Array) -> np.ndarray:
    """Pieces of every row.

    Rows are cut at blanks into words; each word takes the mark of the blank before it,
    and further blanks are marks of their own, as the library's splitting has it.
    """
    out = []
    for _, _, data, offsets in slices(texts):
        words, codes, at = coded_words(data, offsets, line_feed=False)
        n = len(words)
        # A word's trailing blanks: the last one is the mark of the word after it.
        bare = [w.rstrip(" ") for w in words]
        extra = np.fromiter((len(w) - len(b) for w, b in zip(words, bare)), np.int64, n)
        alone = counter.count(MARK)
        first = np.zeros(len(codes), bool)
        first[at[:-1][at[:-1] < at[1:]]] = True
        last = np.zeros(len(codes), bool)
        last[at[1:][at[:-1] < at[1:]] - 1] = True
        empty = np.fromiter((not b for b in bare), bool, n)[codes]
        blanks = extra[codes]
        led = np.zeros(len(codes), bool)
        led[1:] = blanks[:-1] > 0
        # A row that starts with the mark itself gets no other.
        marked = np.fromiter((b.startswith(MARK) for b in bare), bool, n)[codes]
        led = np.where(first, ~marked, led)
        runs = [MARK + b.replace(" ", MARK) for b in bare]
        each = counter.counts(runs)[codes]
        for k in np.flatnonzero(~led):
            each[k] = counter.count_run(runs[codes[k]][1:])
        # Blanks at the start of a row are one word without letters: the first blank is
        # the row's own mark, so all of them count, and its last leads the next word.
        each = np.where(empty, np.where(last, blanks, blanks - 1) * alone, each)
        each += np.where(empty, 0, np.where(last, blanks, np.maximum(blanks - 1, 0)) * alone)
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(each, out=total[1:])
        out.append(total[at[1:]] - total[at[:-1]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and number of tokens of every row of ``docs`` (doc_id, text).

    ``path`` is a model file that every worker can open. A null text counts as empty: 0.
    Null ids stay; repeated rows are counted each; other columns are ignored; no rows
    give no rows. Row-local.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = row_counts(counter_of(path), batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts)], ["doc_id", "n_tokens"]
        )

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return map_batches(rows, step, "doc_id bigint, n_tokens bigint")
