import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from starling.llm import bpe

NAMES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    path = P.path(request.param)
    ours = bpe.encoder(path, P.PATTERN)
    return ours, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ours.vocabulary.ranks, special_tokens={})


def texts(seed, n):
    rng = random.Random(seed)
    kinds = [" \t\n\x0b\x1c\x85\xa0　'sdlmtreve1²½٣é", "aeinst thou\n", "ab", "naïve Straße été — “q” 12 ½ don't I'LL", "日本語 русский ελληνικά 😀🏽 ‍"]
    for _ in range(n):
        alphabet = rng.choice(kinds)
        yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))


def test_as_the_library(both):
    ours, theirs = both
    for t in [*texts(1, 1500), "", " ", "  a", "a  ", "\n a", "a \n b", "x" * 3000, " " * 500, "<|endoftext|>", "the quick brown"]:
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t), repr(t)
        assert ours.decode(ids) == t.encode()


def test_other_patterns_take_the_general_way(both):
    ours, _ = both
    general = bpe.Encoder(ours.vocabulary.ranks, r"\p{L}+|[^\p{L}]")
    assert general.decode(general.encode("héllo, wörld 12")) == "héllo, wörld 12".encode()


def test_appends_and_edits(both):
    v, rng = both[0].vocabulary, random.Random(3)
    for t in texts(2, 60):
        data = (t * 3).encode()
        table = bpe.PrefixTable(v, data[:10])
        table.append(data[10:])
        assert table.ids() == bpe.PrefixTable(v, data).ids() == bpe.encode_piece(v, data)
        a = rng.randrange(len(data) + 1)
        b, new = min(len(data), a + rng.randrange(4)), rng.choice([b"", b"x", b"the and"])
        table.splice(a, b, new)
        assert table.data == data[:a] + new + data[b:] and table.ids() == bpe.PrefixTable(v, table.data).ids()


def test_edits_are_local(both):
    v = both[0].vocabulary
    data = b" the house and the garden of the man " * 200
    assert bpe.PrefixTable(v, data).splice(3000, 3001, b"z") < 500


def test_dynamic_program_is_the_merge_rule(both):
    v = both[0].vocabulary
    for t in texts(4, 300):
        data = t.encode()
        assert bpe.encode_piece(v, data) == [v.ranks[b] for b in bpe.merge_bytes(data, v.ranks)]


def test_small_vocabularies():
    rng = random.Random(5)
    for _ in range(60):
        tokens = [b"a", b"b", b"c"]
        while len(tokens) < 15:
            joined = rng.choice(tokens) + rng.choice(tokens)
            if joined not in tokens:
                tokens.append(joined)
        v = bpe.Vocabulary({t: i for i, t in enumerate(tokens)})
        for _ in range(40):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25)))
            assert bpe.encode_piece(v, data) == [v.ranks[t] for t in bpe.merge_bytes(data, v.ranks)]
        for data in (b"z", b"abzab", b"abz"):
            with pytest.raises(ValueError):
                bpe.encode_piece(v, data)


def test_query(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "é" * 5000, "x")], "doc_id long, text string, n_tokens string")
    rows = bpe.round_trip(df, P.path(NAMES[0]), P.PATTERN).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 5 and [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows if r["doc_id"] in (2, 3)] == [(0, none, none)] * 2
    assert [r["decoded_sha256"] for r in rows if r["doc_id"] is None] == [hashlib.sha256(("é" * 5000).encode()).hexdigest()]
    assert bpe.round_trip(df.limit(0), P.path(NAMES[0]), P.PATTERN).count() == 0
