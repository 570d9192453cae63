"""Byte-level BPE by dynamic programming over prefixes.

A byte string has exactly one valid BPE encoding, and every prefix of a valid
encoding, cut between tokens, is the valid encoding of its bytes. So it is enough
to store, for each byte prefix, the last token of that prefix's encoding: the
token t of length n is the one for which the encoding of the prefix without its
last n bytes, itself known by its last token p, may be followed by t. Whether t
may follow p depends on those two alone: merging the bytes of p and t must never
join across their border.

Following the stored tokens from the end gives the encoding. Appending bytes goes
on with the table as it stands. After an edit the table is valid up to the edit,
and is rebuilt only until as many entries in a row as the longest token has bytes
agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import release

#: Words whose encoding a Python worker remembers, in each of two generations, and the characters of the longest one; no result depends on it.
CACHE_WORDS, LONGEST_WORD = 300_000, 64
#: The same for encode_udf, whose workers go on to other stages: they forget all words at the end of a partition.
CACHE_WORDS_IN_PARTITION = 150_000
#: Pairs of tokens that a worker remembers, to the same effect.
CACHE_PAIRS = 500_000

RESULT_TYPE = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int], parts: int = 1) -> list[bytes]:
    """The plain rule: join the adjacent pair of least rank, leftmost first, until none joins or `parts` are left."""
    out = [piece[i : i + 1] for i in range(len(piece))]
    while len(out) > parts:
        rank, at = min(((ranks.get(out[i] + out[i + 1], 1 << 60), i) for i in range(len(out) - 1)))
        if rank == 1 << 60:
            break
        out[at : at + 2] = [out[at] + out[at + 1]]
    return out


class Vocabulary:
    """Ranks with what the dynamic program asks of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.text_of = {i: str(i) for i in self.bytes_of}
        #: Tokens as a trie, their lengths, and the next shorter token that each begins with.
        self.trie, self.size, self.shorter = ahocorasick.Automaton(ahocorasick.STORE_INTS), {i: len(b) for i, b in self.bytes_of.items()}, {}
        for b, i in ranks.items():
            self.trie.add_word(b.decode("latin-1"), i)
            self.shorter[i] = next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ranks), None)
        self.trie.make_automaton()
        self._edges: dict[bytes, tuple] = {}
        self._follows: dict[int, bool] = {}
        self._made: dict[int, bool] = {}

    def made(self, token: int) -> bool:
        """Whether merging its bytes gives this token; if not, it only stands for a whole piece."""
        known = self._made.get(token)
        if known is None:
            known = self._made[token] = len(merge_bytes(self.bytes_of[token], self.ranks)) == 1
        return known

    def edges(self, token: bytes) -> tuple[list, list]:
        """What stands at the left and at the right end of the token while it is merged: (bytes, rank it is made at, rank it is used up at)."""
        known = self._edges.get(token)
        if known is None:
            sides: tuple[list, list] = ([], [])
            for side, end in ((sides[0], 0), (sides[1], 1)):
                at, used = token, 1 << 60
                while True:
                    made = self.ranks[at] if len(at) > 1 else -1
                    side.append((at, made, used))
                    if len(at) == 1:
                        break
                    used, at = made, merge_bytes(at, self.ranks, 2)[end]
            known = self._edges[token] = sides
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether `right` may stand after `left`: merging makes it, and no merge ever joins across their border."""
        key = left << 32 | right
        known = self._follows.get(key)
        if known is None:
            known, get = self.made(right), self.ranks.get
            for x, x_made, x_used in self.edges(self.bytes_of[left])[1] if known else ():
                for y, y_made, y_used in self.edges(self.bytes_of[right])[0]:
                    rank = get(x + y)
                    if rank is not None and rank < x_used and rank <= y_used and x_made < y_used and y_made < x_used:
                        known = False
            if len(self._follows) >= CACHE_PAIRS:
                self._follows.clear()
            self._follows[key] = known
        return known


class PrefixTable:
    """The last token of each prefix of some bytes, which can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _last(self, end: int) -> int:
        """The last token of the prefix of `end` bytes, from those of shorter prefixes."""
        v, data, last = self.v, self.data, self.last
        for start in range(max(0, end - v.longest), end):
            token = v.ranks.get(data[start:end])
            if token is not None and (v.follows(last[start - 1], token) if start else v.made(token)):
                return token
        raise ValueError(f"the vocabulary has no token for byte {data[end - 1]}")

    def append(self, more: bytes) -> None:
        for _ in more:
            self.last.append(None)
        self.data += more
        for end in range(len(self.data) - len(more) + 1, len(self.data) + 1):
            self.last[end - 1] = self._last(end)

    def splice(self, start: int, stop: int, new: bytes) -> int:
        """Replaces bytes start..stop by new; returns how many entries were computed again."""
        old, moved, same = self.last, len(new) - (stop - start), 0
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last(end))
            same = same + 1 if end > start + len(new) and old[end - moved - 1] == self.last[-1] else 0
            if same >= self.v.longest:  # later entries see nothing else
                break
        done = len(self.last)
        self.last += old[done - moved :]
        return done - start

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


def encode_piece(v: Vocabulary, data: bytes) -> list[int]:
    """The ids of bytes encoded once: the same table, filled only for the prefixes that longest matches lead to.

    A prefix has one valid last token, so however a prefix is reached its entry is
    right, and one that was reached and couldn't be gone on from needs no second look."""
    n, text, shorter, size, follows = len(data), data.decode("latin-1"), v.shorter, v.size, v._follows.get
    last, longest = [None] * (n + 1), [None] * n
    for end, token in v.trie.iter_long(text):
        longest[end + 1 - size[token]] = token
    at, left, stack = 0, None, []
    while at < n:
        token = longest[at]
        if token is None:  # not among the longest matches from the start
            end, token = next(v.trie.iter_long(text, at), (n, None))
            if token is not None and end + 1 - size[token] != at:
                token = None
        while True:
            while token is not None:
                end = at + size[token]
                if last[end] is None:
                    fits = v.made(token) if left is None else follows(left << 32 | token)
                    if v.follows(left, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token is not None:
                break
            if not stack:
                return PrefixTable(v, data).ids()
            at, left, token = stack.pop()
            token = shorter[token]
        last[end] = token
        stack.append((at, left, token))
        at, left = end, token
    return [token for _, _, token in stack]


class _Words(dict):
    """Encodings of words after a space; those not asked for during a generation are forgotten."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.pop(word, None) or self.encode(word)
        if len(word) > LONGEST_WORD:
            return ids
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old = {}


# The usual splitting pattern, and one for Python's own engine that agrees with it on plain texts.
# Those hold no white space but spaces and line feeds, nothing beyond the first plane, and no character whose
# class the two engines see differently.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = r""" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def _plain_tools():
    """A search for what makes a text not plain, and the findall of PLAIN."""
    import re

    import regex

    plane = list(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
    odd = {c for c in plane if c.isspace() and c not in " \n"}
    for ours, theirs in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\p{White_Space}")):
        mine, other = re.compile(ours), regex.compile(theirs)
        odd |= {c for c in plane if bool(mine.match(c)) != bool(other.match(c))}
    return re.compile(f"[{re.escape(''.join(sorted(odd)))}\ud800-\udfff\U00010000-\U0010ffff]").search, re.compile(PLAIN).findall


class Encoder:
    """Splits a text by a pattern and encodes each match by itself.

    Under the usual pattern a match ends before any space that stands between two
    characters that are no white space, so a plain text is first cut there."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.vocabulary, self.split, self.usual = Vocabulary(ranks), regex.compile(pattern).findall, pattern == USUAL
        self.words = _Words(self._word, CACHE_WORDS)
        self.not_plain, self.split_plain = _plain_tools() if self.usual else (None, None)

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(data)
        return [whole] if whole is not None else encode_piece(self.vocabulary, data)

    def _word(self, word: str) -> tuple[int, ...]:
        if word.isalpha():  # one piece
            return tuple(self._piece(" " + word))
        pieces = self.split_plain(" " + word)
        if len(pieces) == 1:
            return tuple(self._piece(pieces[0]))
        return tuple(chain.from_iterable(self.words[p[1:]] if p[0] == " " and len(p) > 1 else self._piece(p) for p in pieces))

    def encode(self, text: str) -> list[int]:
        if not self.usual or self.not_plain(text):
            return [i for p in self.split(text) for i in self._piece(p)]
        if not text or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
            return [i for p in self.split_plain(text) for i in (self.words[p[1:]] if p[0] == " " and len(p) > 1 and p[1] not in " \n" else self._piece(p))]
        first, *rest = text.split(" ")
        ids = [i for p in self.split_plain(first) for i in self._piece(p)]
        ids.extend(chain.from_iterable(map(self.words.__getitem__, rest)))
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def joined(self, ids) -> str:
        return ",".join(map(self.vocabulary.text_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(load_ranks(path), pattern)


def _in_partition(path: str, pattern: str, texts, work, words: int, forget: bool):
    """work(encoder, array) for each array of a partition, remembering so many words, until its end if they are to be forgotten."""
    e = encoder(path, pattern)
    e.words.limit = words
    try:
        for text in texts:
            yield work(e, text)
    finally:
        if forget:
            e.words.forget()
        release()


def _packed(rows: list[np.ndarray], mask: pa.Array | None = None) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])), mask=mask)


def encode_udf(path: str, pattern: str):
    """text -> (array<int> of token ids, whether they decode to the text); a null text gives null ids."""

    def work(e: Encoder, text: pa.Array) -> pa.Array:
        rows, exact = [], []
        for x in text:  # each row's ids are packed at once: lists of a whole batch would take many times the room
            said = x.as_py() or ""
            ids = e.encode(said)
            rows.append(np.array(ids, dtype=np.int32))
            exact.append(e.decode(ids) == said.encode("utf-8", "surrogatepass"))
        return pa.StructArray.from_arrays([_packed(rows, pa.array(text.is_null())), pa.array(exact, pa.bool_())], ["ids", "exact"])

    @F.arrow_udf("ids array<int>, exact boolean")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _in_partition(path, pattern, texts, work, CACHE_WORDS_IN_PARTITION, True)

    return encode


def decode_udf(path: str, pattern: str):
    """array<int> -> binary; null gives null."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        e = encoder(path, pattern)
        return pa.array([e.decode(x.as_py()) if x.is_valid else None for x in ids], type=pa.binary())

    return decode


def _digest_udf(path: str, pattern: str):
    def work(e: Encoder, text: pa.Array) -> pa.Array:
        n, of_ids, of_bytes = [], [], []
        for x in text:
            ids = e.encode(x.as_py() or "")
            n.append(len(ids))
            of_ids.append(hashlib.sha256(e.joined(ids).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(e.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    @F.arrow_udf(RESULT_TYPE)
    def digest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _in_partition(path, pattern, texts, work, CACHE_WORDS, False)

    return digest


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, for every row; a null text counts as empty.

    The rank file at `path` must be there on every executor. Repeated rows give
    repeated results, an empty table none; other columns of docs are ignored.
    """
    return docs.select(F.col(id_col).alias("doc_id"), _digest_udf(path, pattern)(F.col(text_col)).alias("r")).select("doc_id", "r.*")
