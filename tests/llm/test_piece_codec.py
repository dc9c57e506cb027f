import itertools
import random

import pyarrow as pa
import pytest
import sentencepiece

from rowloom.llm import piece_codec as pc


@pytest.fixture(scope="module")
def codec():
    return pc.PieceCodec(pc.PieceTable.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pc.MODEL)


ALPHABETS = ["abcdefgh ", "the in on er and   ", "▁ a", "éüñ漢字🎉 x\n\t", " ", "0123456789.,-  ", "\n \n ab", "aA zZ!!  ??", "<0x41> <s> </s> <unk>"]


def test_ids_are_the_model_s_own(codec, library):
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randrange(40)))
        assert codec.encode(t).tolist() == library.encode(t), t
        assert codec.decode(codec.encode(t).tolist()) == t.replace("▁", " ")


def test_documents(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = pc.op9_piece_codec(spark, sf)
    for r in out.collect():
        assert r["exact"] and r["n_tokens"] == len(r["ids"]) and r["ids"] == library.encode(texts[r["doc_id"]] or "")
    back = {r["doc_id"]: r["text"] for r in pc.decode_documents(out).collect()}
    assert back == {k: v or "" for k, v in texts.items()}


def test_unigram_takes_the_best_sum():
    scores = {"▁a": -1.0, "▁": -3.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁ab": -6.0, "ba": -3.0, "aba": -3.2}
    table = pc.PieceTable(["<unk>", *scores], [0.0, *scores.values()], [2] + [1] * len(scores), False, True, 0)
    c = pc.PieceCodec(table)

    def best(s):
        found = []
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            parts, at = [], 0
            for i, cut in enumerate(cuts, 1):
                if cut:
                    parts.append(s[at:i])
                    at = i
            parts.append(s[at:])
            if all(p in scores for p in parts):
                found.append(sum(scores[p] for p in parts))
        return max(found)

    for n in range(1, 7):
        for letters in itertools.product("ab", repeat=n):
            t = "".join(letters)
            ids = c.encode(t).tolist()
            assert sum(table.scores[i] for i in ids) == pytest.approx(best("▁" + t)), t
            assert c.decode(ids) == t
    assert c.encode("a?b").tolist().count(0) == 1


def test_one_link_at_each_position_is_admissible(codec):
    rng = random.Random(5)
    for _ in range(300):
        w = pc.MARK + "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 9)))
        last = {0: -1}
        for end in range(1, len(w) + 1):
            fits = [codec.ids[w[at:end]] for at in range(end) if w[at:end] in codec.ids and at in last and codec.may_follow(last[at], codec.ids[w[at:end]])]
            assert len(fits) == 1
            last[end] = fits[0]


def test_pieces_follow_as_merging_says(codec):
    rng, pieces, ids = random.Random(7), codec.t.pieces, list(codec.ids.values())
    for _ in range(20_000):
        a, b = rng.choice(ids[: rng.choice([300, 3000, len(ids)])]), rng.choice(ids[: rng.choice([300, 3000, len(ids)])])
        assert codec.may_follow(a, b) == (codec.merged(pieces[a] + pieces[b]) == [pieces[a], pieces[b]]), (pieces[a], pieces[b])


def test_a_word_is_segmented_once_in_a_column(library, monkeypatch):
    """Texts are encoded by columns: repeated words cost one run of the automaton, remembered or not."""
    monkeypatch.setattr(pc, "_REMEMBER", 0)
    c, seen = pc.PieceCodec(pc.PieceTable.read()), []
    c.known.encode = lambda w, f=c.word: seen.append(w) or f(w)
    texts = ["", " two  words", "\n\n two words \n", "two ▁ words", "  ", "x" * 90 + " é漢🎉 two"] * 50
    column = pa.array([t.encode() for t in ["cut off", *texts]], pa.binary()).slice(1)
    ids = c.encode_all(column)
    assert ids.to_pylist() == [library.encode(t) for t in texts] and len(seen) == len(set(seen)) <= 10
    assert c.exact_all(ids, column) == ["▁" not in t for t in texts]
    assert [p.to_pylist() for p in pc._parts(column)] == [column.to_pylist()]
    monkeypatch.setattr(pc, "_PART", 20)
    assert all(len(p) == 1 or sum(map(len, p.to_pylist())) <= 20 for p in pc._parts(column))
    assert [t for p in pc._parts(column) for t in p.to_pylist()] == column.to_pylist()


def test_large_vocabularies_and_full_caches(monkeypatch, library):
    """More than 65,536 pieces: pairs of pieces keep keys of their own; caches may overflow."""
    filler = [f"<{i}>" for i in range(70_000)]
    letters, merges = [pc.MARK, *"abc"], ["ab", "abc", "bc", "ca"]
    pieces = ["<unk>", *filler, *letters, *merges]
    scores = [0.0] * (1 + len(filler)) + [-100.0] * len(letters) + [-float(k) for k in range(len(merges))]
    kinds = [2] + [5] * len(filler) + [1] * (len(letters) + len(merges))
    small = pc.PieceTable([p for p, k in zip(pieces, kinds) if k != 5], [s for s, k in zip(scores, kinds) if k != 5], [k for k in kinds if k != 5], True, True, 0)
    large, plain = pc.PieceCodec(pc.PieceTable(pieces, scores, kinds, True, True, 0)), pc.PieceCodec(small)
    monkeypatch.setattr(pc, "_PAIRS", 3)
    monkeypatch.setattr(pc, "_REMEMBER", 2)
    rng = random.Random(6)
    for _ in range(500):
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 12)))
        assert [pieces[i] for i in large.encode(t)] == [small.pieces[i] for i in plain.encode(t)]
    assert len(large.follows) <= 3 and len(large.known) <= 2
    c = pc.PieceCodec(pc.PieceTable.read())
    assert c.encode("z" * 500).tolist() == library.encode("z" * 500) and not any(len(w) > pc._LENGTH for w in c.known)


def test_odd_rows(spark, odd_docs, no_docs):
    out = pc.encode_documents(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert [r["exact"] for r in rows if r["doc_id"] == 9] == [False]  # the word mark reads as a space
    assert all(r["exact"] for r in rows if r["doc_id"] != 9)
    assert pc.encode_documents(no_docs).count() == 0 and pc.decode_documents(pc.encode_documents(no_docs)).count() == 0
