"""Token counts: the exact number of BPE tokens of every prefix of a text, by prefix dynamic programming.

The encoding of a byte-pair vocabulary is characterised by its last token: for every prefix of a word exactly
one token of the vocabulary can end it such that the two last tokens, encoded together, stay the same two
tokens. So one pass over a word gives the last token of every prefix, and
``count[i] = count[i - len(last[i])] + 1``. Words are independent of each other, which leaves a row of small
steps (-n to +n, one signed byte per code point) for every text: their running sum is the token count at every
prefix, and truncation and budget questions are answered from it without encoding again.

Null texts count as empty (no step, no token). Rows are independent, so ties and repeated rows are no special
case; an empty table gives an empty result. Only the id and text columns are read, whatever others are called.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that a worker remembers, for bounded memory.
MAX_UNITS, MAX_PAIRS = 400_000, 500_000

#: The pattern by which this vocabulary cuts text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: White space with the word after it: what a cut inside white space does stays within such a unit.
#: (A contraction stands alone or after white space that does not end in a plain space.)
UNITS = r"\p{White_Space}*\p{L}+|(?:\p{White_Space}*(?! )\p{White_Space})?'(?:[sdmt]|ll|ve|re)|\p{White_Space}*(?:\p{N}+|[^\p{White_Space}\p{L}\p{N}]+)|\p{White_Space}+"
#: The same for texts of code points below U+02B0, where the three classes are short.
_S, _L, _N = r"\t-\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_UNITS = f"[{_S}]*[{_L}]+|(?:[{_S}]*(?! )[{_S}])?'(?:[sdmt]|ll|ve|re)|[{_S}]*(?:[{_N}]+|[^{_S}{_L}{_N}]+)|[{_S}]+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, str]:
    """The printable letters that stand for bytes in the vocabulary file, as Latin-1 characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts at all prefixes of texts, for one byte-level BPE vocabulary (a tokenizers .json file).

    Words are handled as Latin-1 strings of their UTF-8 bytes. Added special tokens count as one token wherever
    they stand whole, as the library has it by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = str.maketrans(_byte_letters())
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = [(a.translate(letters), b.translate(letters)) for a, b in pairs]
        ids = {chr(b): b for b in range(256)}
        self.split, self.merged = [(b, b) for b in range(256)], {}
        for a, b in pairs:
            token = len(self.split)
            self.split.append((ids[a], ids[b]))
            self.merged[ids[a] << 20 | ids[b]] = token
            ids.setdefault(a + b, token)
        self.tokens = ahocorasick.Automaton()
        for text, token in ids.items():
            self.tokens.add_word(text, (token, len(text)))
        self.tokens.make_automaton()
        self.words, self.units, self.latin = regex.compile(WORDS), regex.compile(UNITS), re.compile(LATIN_UNITS)
        self.beyond_latin = re.compile("[^\0-\u02af]")
        specials = [t["content"] for t in spec.get("added_tokens", ()) if t.get("special")]
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self._steps: dict[str, bytes] = {}
        self._pairs: dict[int, bool] = {}

    def _joins(self, left: int, right: int) -> bool:
        """Whether the two tokens, encoded together, stay the same two tokens.

        Undoes the merges of both at their common border, latest first: the pair fails as soon as a merge
        across the border would have come before the one just undone.
        """
        split, merged, a, b, limit = self.split, self.merged, left, right, 1 << 60
        while True:
            across = merged.get(a << 20 | b)
            if across is not None and across < limit:
                return False
            if a > b and a > 255:
                limit, a = a, split[a][1]
            elif b > 255:
                limit, b = b + 1, split[b][0]
            elif a > 255:
                limit, a = a, split[a][1]
            else:
                return True

    def prefix_counts(self, word: str) -> list[int]:
        """Token counts of word[:0], word[:1], ..., the whole word (bytes as Latin-1): one step each.

        The automaton gives, end by end and longest first, the vocabulary tokens that can be last.
        """
        pairs = self._pairs
        size = len(word) + 1
        counts, last = [0] * size, [-1] * size
        for end, (token, n) in self.tokens.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            start = end - n
            if not start:
                counts[end], last[end] = 1, token
                continue
            key = last[start] << 20 | token
            known = pairs.get(key)
            if known is None:
                known = self._joins(last[start], token)
                if len(pairs) >= MAX_PAIRS:
                    pairs.clear()
                pairs[key] = known
            if known:
                counts[end], last[end] = counts[start] + 1, token
        return counts

    def _word_counts(self, word: str) -> list[int]:
        """Token counts of word[:1], word[:2], ... by code points."""
        if word.isascii():
            return self.prefix_counts(word)[1:]
        at, end, out = self.prefix_counts(word.encode().decode("latin-1")), 0, []
        for c in word:
            end += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            out.append(at[end])
        return out

    def _unit_counts(self, unit: str) -> list[int]:
        """The same for a unit, whose prefixes are cut into words anew where white space or ' leads it."""
        core = unit.lstrip("\t\n\x0b\x0c\r \x85\xa0")
        spaces = len(unit) - len(core)
        if core and core[0] != "'" and not core[0].isspace() and (not spaces or unit[:spaces] == " "):
            return self._word_counts(unit)
        if not core:
            # a run of white space alone: each of its prefixes is one word
            return self._word_counts(unit)
        words = self.words.findall(unit)
        head = [self._text_count(unit[:i]) for i in range(max(1, len(unit) - len(words[-1])), min(len(unit), len(unit) - len(words[-1]) + 4) + 1)]
        lead = len(unit) - len(words[-1])
        run = self._word_counts(unit[:lead]) if lead else []
        head = head if not lead else head[1:]
        base = sum(self._word_counts(w)[-1] for w in words[:-1])
        return run + head + [base + c for c in self._word_counts(words[-1])[len(head) :]]

    def _text_count(self, text: str) -> int:
        return sum(self._word_counts(w)[-1] for w in self.words.findall(text))

    def _unit_steps(self, unit: str) -> bytes:
        before, out = 0, []
        for count in self._unit_counts(unit):
            step, before = count - before, count
            if not -128 <= step <= 127:
                raise OverflowError("a step beyond one signed byte")
            out.append(step & 255)
        steps = bytes(out)
        if len(unit) <= 40:
            if len(self._steps) >= MAX_UNITS:
                self._steps.clear()
            self._steps[unit] = steps
        return steps

    def _cut(self, text: str) -> list[str]:
        return (self.units if self.beyond_latin.search(text) else self.latin).findall(text)

    def _plain(self, text: str) -> bytes:
        known, slow = self._steps.get, self._unit_steps
        return b"".join([known(u) or slow(u) for u in self._cut(text)])

    def steps(self, text: str) -> bytes:
        """One signed byte per code point; the running sum is the token count of each prefix."""
        if self.specials is None or "<" not in text or not self.specials.search(text):
            return self._plain(text)
        out, done = [], 0
        for m in self.specials.finditer(text):
            before = text[done : m.start()]
            out.append(self._plain(before))
            # inside the special string a prefix ends in ordinary text, which may join the unit before it
            unit = (self._cut(before) or [""])[-1]
            closed = self._text_count(unit)
            here, row = closed, []
            for i in range(1, len(m[0]) + 1):
                now = self._text_count(unit + m[0][:i]) if i < len(m[0]) else closed + 1
                row.append(now - here & 255)
                here = now
            out.append(bytes(row))
            done = m.end()
        return b"".join([*out, self._plain(text[done:])])


_counters: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_token_steps(df: DataFrame, id_col: str, text_col: str, ranks_path: str | None = None) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens, and `steps`, the stored table of prefix counts.

    `steps` has a signed byte per code point; `tokens_at_prefix` and `longest_prefix_within` read it. The ranks
    file must be readable on every executor (it is part of an installed package).
    """
    path = ranks_path or vocabulary_path()
    id_type = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [counter.steps(t or "") for t in part.column(1).to_pylist()]
                totals = [int(np.frombuffer(r, np.int8).sum(dtype=np.int64)) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(totals, pa.int64()), pa.array(rows, pa.binary())], ["id", "n_bytes", "n_tokens", "steps"])

    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return plain.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, steps binary").withColumnRenamed("id", id_col)


def tokens_at_prefix(steps: bytes, n_chars: int) -> int:
    """Token count of the first n_chars code points."""
    return int(np.frombuffer(steps, np.int8)[:n_chars].sum(dtype=np.int64))


def longest_prefix_within(steps: bytes, limit: int) -> int:
    """Code points of the longest prefix of at most `limit` tokens."""
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    return int(np.flatnonzero(np.append(True, counts <= limit))[-1])


def over_limit(n_tokens: Column, limit: int = 512) -> Column:
    return n_tokens > limit
