"""Texts as dictionary-coded words: each distinct word of a slice is handled once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kurzwerk.llm.common import strings_between

#: ASCII letters and digits, and ASCII signs but for those of special tokens.
LETTER = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
SIGN = np.array([32 < c < 127 and not chr(c).isalnum() and chr(c) not in "<|>_" for c in range(256)])


def coded_words(
    data: np.ndarray, offsets: np.ndarray, line_feed: bool = True, caseless: bool = False
):
    """(distinct words, code of every word, first word of every row).

    A word is a run without space (and line feed, if it parts words) together with
    those after it, so that the words of a row are exactly its bytes. Blanks at the
    start of a row are a word. For a tokenizer that ignores case, drops blanks and parts
    letters, single digits and signs, ``caseless`` makes far fewer words distinct: blanks
    belong to the word behind them, whose first ASCII letter is put in lower case, and
    behind a letter or digit (ASCII, or a letter of Latin-1) an ASCII sign starts a word.
    Signs that special tokens are written with do not.
    """
    gap = data == 32
    if line_feed:
        gap |= data == 10
    start = np.zeros(len(data), bool)
    start[1:] = gap[1:] & ~gap[:-1] if caseless else gap[:-1] & ~gap[1:]
    if caseless:
        start[1:] |= SIGN[data[1:]] & LETTER[data[:-1]]
        # 0xC3 begins letters of two bytes, but for the signs of times and division.
        latin = (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        start[2:] |= SIGN[data[2:]] & latin
    start[offsets[offsets < len(data)]] = True
    cuts = np.append(np.flatnonzero(start), len(data))
    if caseless:
        first = start[: len(data)].copy()
        first[1:] |= gap[:-1]
        data = data + np.uint8(32) * (first & (data >= 65) & (data <= 90))
    coded = strings_between(data, cuts).dictionary_encode()
    words = coded.dictionary.cast(pa.large_string()).to_pylist()
    return words, coded.indices.to_numpy(), np.searchsorted(cuts[:-1], offsets)
