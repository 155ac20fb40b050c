"""Licence evidence in texts: tags with expressions, and phrases of notices."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kurzwerk.llm.common import map_batches, ragged_take, slices
from kurzwerk.llm.terms import folded_terms

#: The phrases every scan looks for, with the labels they stand for.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Words of notices and headings, with the licences they name.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache 2 0 license": "apache-2",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu gpl": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "released into the public domain": "public-domain",
    "cc0": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
}
#: Words of tags; a colon or equals sign and an expression follow them.
TAGS = ("spdx license identifier", "license expression", "spdx licence identifier")

#: What a licence asks of its users: nothing but a notice, changes to its own files,
#: the whole work, or restrictions of use; a name that is in no family is unknown.
PERMISSIVE, FILES, WORK, UNKNOWN, RESTRICTED = range(5)
FAMILIES = {
    "mit": PERMISSIVE, "apache": PERMISSIVE, "bsd": PERMISSIVE, "0bsd": PERMISSIVE,
    "isc": PERMISSIVE, "bsl": PERMISSIVE, "zlib": PERMISSIVE, "unlicense": PERMISSIVE,
    "public-domain": PERMISSIVE, "cc0": PERMISSIVE, "cc-by": PERMISSIVE,
    "lgpl": FILES, "mpl": FILES, "epl": FILES,
    "gpl": WORK, "agpl": WORK, "cc-by-sa": WORK,
    "cc-by-nc": RESTRICTED, "cc-by-nd": RESTRICTED,
}
#: How sure a piece of evidence makes of its label.
SURE = {"base": 0.8, "notice": 0.6, "tag": 0.95}

SPAN_TYPE = pa.struct([
    ("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int64()),
    ("n_words", pa.int64()), ("expression", pa.string()), ("demands", pa.int32()),
])
SCHEMA = (
    "doc_id bigint, n_words bigint, spans array<struct<kind:string,label:string,"
    "first_word:bigint,n_words:bigint,expression:string,demands:int>>"
)


# --- expressions ----------------------------------------------------------------


def label_of(name: str) -> str:
    """The label of a licence identifier: no case, no closing .0, no "only" or "or later";
    Creative Commons names without version, as their phrases have none."""
    name = re.sub(r"(-only|-or-later|\+)$", "", name.lower())
    name = re.sub(r"(\.0)+$", "", name)
    if name.startswith("cc-by"):
        name = re.sub(r"-[0-9.]+$", "", name)
    return "cc0" if name.startswith("cc0") else name


def demands_of(label: str) -> int:
    """The class of the longest family name that starts a label."""
    parts = label.split("-")
    for n in range(len(parts), 0, -1):
        if (kind := FAMILIES.get("-".join(parts[:n]))) is not None:
            return kind
    return UNKNOWN


@dataclass
class Value:
    """Outcome of an expression: labels of its licences, what it demands, how it reads."""

    labels: list[str]
    demands: int
    text: str


def excepted(licence: int, exception: int) -> int:
    """With an exception, what asked for the whole work asks for its own files."""
    return FILES if licence == WORK else licence


#: Operators by rank, a higher one binds closer; ``or`` lets the user choose the least.
OPERATORS = {b"or": (1, min), b"and": (2, max), b"with": (3, excepted)}
NAME = rb"[A-Za-z0-9][A-Za-z0-9.+-]*"
TOKEN = re.compile(rb"[ \t]*(\(|\)|(?:DocumentRef-" + NAME + rb":)?" + NAME + rb")", re.A)


def evaluate(raw: bytes, at: int = 0, end: int | None = None) -> Value | None:
    """Value of the licence expression that starts at ``at``; None if there is none.

    Dijkstra's two stacks. Reading stops at what cannot go on the expression (the end of
    the line, a comment's end, a second name without operator); an operator without right
    side is passed over, parentheses left open are closed.
    """
    end = len(raw) if end is None else end
    values: list[int] = []
    waiting: list[bytes] = []
    read: list[bytes] = []
    labels: set[str] = set()

    def apply() -> None:
        right, left = values.pop(), values.pop()
        values.append(OPERATORS[waiting.pop()][1](left, right))

    name_next, opened = True, 0
    while found := TOKEN.match(raw, at, end):
        word = found[1].lower()
        if name_next:
            exception = bool(waiting) and waiting[-1] == b"with"
            if word == b")" or word in OPERATORS or (exception and word == b"("):
                break
            if word == b"(":
                waiting.append(word)
                opened += 1
            else:
                label = label_of(word.decode())
                if not exception:
                    labels.add(label)
                values.append(demands_of(label))
                name_next = False
        elif word in OPERATORS:
            rank = OPERATORS[word][0]
            while waiting and waiting[-1] != b"(" and OPERATORS[waiting[-1]][0] >= rank:
                apply()
            waiting.append(word)
            name_next = True
        elif word == b")" and opened:
            while waiting[-1] != b"(":
                apply()
            waiting.pop()
            opened -= 1
        else:
            break
        read.append(word)
        at = found.end()
    if not values:
        return None
    while name_next:  # nothing came behind the last tokens
        name_next = waiting.pop() == b"("
        opened -= name_next
        read.pop()
    while waiting:
        if waiting[-1] == b"(":
            waiting.pop()
        else:
            apply()
    text = b" ".join(read + [b")"] * opened).decode()
    return Value(sorted(labels), values[0], text.replace("( ", "(").replace(" )", ")"))


# --- search ---------------------------------------------------------------------


class Scanner:
    """One Aho-Corasick automaton over the words of phrases and tags."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, str | None]]] = {}
        for kind, phrases in (("base", base), ("notice", notices), ("tag", dict.fromkeys(tags))):
            for phrase, label in phrases.items():
                kinds.setdefault(phrase, []).append((kind, label))
        for phrase, found in kinds.items():
            # The texts are searched as bytes, one character each.
            key = phrase.encode().decode("latin-1")
            self.automaton.add_word(key, (len(key), phrase.count(" ") + 1, found))
        self.automaton.make_automaton()

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list]]:
        """(words of every row, spans of every row in order of their first word)."""
        folded, starts, ends, rows = folded_terms(data, offsets)
        sizes = ends - starts
        # The words with one blank behind each; a line feed behind the last of a row.
        begin = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(sizes + 1, out=begin[1:])
        joined = np.full(begin[-1], 32, np.uint8)
        joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = (
            ragged_take(folded, starts, sizes)
        )
        joined[begin[rows[1:][rows[1:] > 0]] - 1] = 10
        out: list[list] = [[] for _ in range(len(offsets) - 1)]
        if not len(joined):
            return np.diff(rows), out
        hits, raw = [], None
        for last, (size, n_words, found) in self.automaton.iter(joined.tobytes().decode("latin-1")):
            first = last + 1 - size
            if joined[last + 1] in (10, 32) and (not first or joined[first - 1] in (10, 32)):
                hits.append((first, n_words, found))
        at = np.searchsorted(begin, [h[0] for h in hits])
        row = np.searchsorted(rows, at, "right") - 1
        for k, (_, n_words, found) in enumerate(hits):
            word, r = int(at[k]), int(row[k])
            for kind, label in found:
                if kind != "tag":
                    span = [kind, label, word - int(rows[r]), n_words, None, demands_of(label)]
                    out[r].append(span)
                    continue
                raw = data.tobytes() if raw is None else raw
                value = behind(raw, int(ends[word + n_words - 1]), int(offsets[r + 1]))
                for name in value.labels if value else ():
                    out[r].append(
                        ["tag", name, word - int(rows[r]), n_words, value.text, value.demands]
                    )
        return np.diff(rows), [without_inner(spans) for spans in out]


#: What may stand between a tag's words and its expression.
COLON = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")


def behind(raw: bytes, at: int, end: int) -> Value | None:
    """The expression behind a tag, on the same line."""
    colon = COLON.match(raw, at, end)
    return evaluate(raw, colon.end(), end) if colon else None


def without_inner(spans: list[list]) -> list[list]:
    """Spans without those notices that lie within a longer phrase; sorted by place."""
    spans = sorted(spans, key=lambda s: (s[2], -s[3], s[0], s[1]))
    out, reach, longest = [], -1, None
    for span in spans:
        place = span[2], span[2] + span[3]
        if span[0] != "notice" or place[1] > reach or place == longest:
            out.append(span)
        if span[0] != "tag" and place[1] > reach:
            reach, longest = place[1], place
    return out


#: Scanners of this process, by their phrases.
SCANNERS: dict[tuple, Scanner] = {}


def scanner_of(base: dict, notices: dict, tags: tuple) -> Scanner:
    key = (tuple(base.items()), tuple(notices.items()), tags)
    if key not in SCANNERS:
        SCANNERS[key] = Scanner(base, notices, tags)
    return SCANNERS[key]


def find_licences(
    docs: DataFrame,
    base: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    tags: tuple[str, ...] = TAGS,
) -> DataFrame:
    """Licence evidence of every row of ``docs`` (doc_id, text): doc_id, n_words, spans.

    Words are runs of ASCII letters and digits and of all beyond ASCII, in lower case;
    phrases match whole words, whatever stands between them. A span has its kind (base,
    notice or tag), label, first word and number of words; a tag's spans are one per
    licence of its expression, with the expression as read and what it demands as a
    whole: ``and`` the more, ``or`` the less, ``with`` an exception from the whole work.
    Notices inside of a longer phrase are left out, base phrases never.

    A null text counts as empty. Null ids stay null. Repeated rows are scanned each;
    other columns are ignored; no rows give no rows. Row-local. Phrases are words in
    lower case, parted by one blank.
    """
    base = dict(BASE if base is None else base)
    notices = dict(NOTICES if notices is None else notices)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = scanner_of(base, notices, tags)
        counts, spans = [], []
        for _, _, data, offsets in slices(batch.column("text")):
            n_words, found = scanner.spans(data, offsets)
            counts.append(n_words)
            spans += found
        names = [f.name for f in SPAN_TYPE]
        rows = [[dict(zip(names, span)) for span in found] for found in spans]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.concatenate(counts), pa.int64()),
                pa.array(rows, pa.list_(SPAN_TYPE)),
            ],
            ["doc_id", "n_words", "spans"],
        )

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return map_batches(rows, step, SCHEMA)


def summary(docs: DataFrame, **phrases) -> DataFrame:
    """Counts and labels of ``find_licences`` per row, and a score.

    The score is 1 less the product, over the distinct labels in order, of what the best
    evidence of a label leaves unsure; 0 without evidence. ``demands`` is the largest
    demand of any span (0 permissive, 1 its files, 2 the whole work, 3 unknown,
    4 restricted use), null without evidence.
    """
    found = find_licences(docs, **phrases)
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    labels = lambda spans: F.array_sort(F.array_distinct(spans["label"]))
    sure = F.create_map(*[F.lit(x) for pair in SURE.items() for x in pair])

    def left(label):
        best = F.transform(
            F.filter("spans", lambda s: s["label"] == label), lambda s: sure[s["kind"]]
        )
        return 1 - F.array_max(best)

    unsure = F.aggregate(
        labels(F.col("spans")), F.lit(1.0), lambda so_far, label: so_far * left(label)
    )
    return found.withColumn("base", of_kind("base")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.col("base")["first_word"]).alias("first_word"),
        F.array_max(F.col("base")["first_word"]).alias("last_word"),
        F.array_join(labels(F.col("base")), ",").alias("base_labels"),
        F.array_join(labels(F.col("spans")), ",").alias("labels"),
        F.round(1 - unsure, 6).alias("score"),
        F.array_max(F.col("spans")["demands"]).alias("demands"),
        F.array_distinct(of_kind("tag")["expression"]).alias("expressions"),
    )
