"""N-best segmentation against the library's own n-best search on a model of the same pieces."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece as sp
from sentencepiece import sentencepiece_model_pb2 as pb

from lorelink.llm import nbest

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def vocab():
    return nbest.load_vocabulary(MODEL)


@pytest.fixture(scope="module")
def library(vocab):
    """A unigram model with the pieces and scores of ``vocab``."""
    model = pb.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    for piece, score in zip(model.pieces, vocab.scores):
        piece.score = 0.0 if math.isnan(score) else float(score)
    return sp.SentencePieceProcessor(model_proto=model.SerializeToString())


def texts():
    r = random.Random(1)
    some = ["Hello world", "", " ", "  two  spaces ", "line\nend\tand tab", "中文 und Größe 😀 ok", "a", "ñandú" * 40, "x" * 300, "the cat sat", None]
    return some + [" ".join("".join(r.choice("theandionr") for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 20))) for _ in range(30)]


def test_best_paths_equal_the_library(vocab, library):
    encoder = nbest.Encoder(vocab, 4)
    for text in texts():
        words = encoder.words(text or "")
        if not words:
            continue
        encoder.learn([words])
        ids, count, scores, others = encoder.encode(words)
        want = library.encode_as_ids(text)
        lattice = library.nbest_encode_as_ids(text, 4) if len(text) < 200 else []
        mine = np.frombuffer(ids, np.int32).tolist()
        assert len(mine) == count
        if lattice:
            score = lambda path: sum(vocab.scores[i] for i in path)
            paths = [mine]
            for change in others:
                path = list(mine)
                for at, many, new in sorted(change, reverse=True):
                    path[at : at + many] = new
                paths.append(path)
            known = [p for p in paths if not any(math.isnan(vocab.scores[i]) for i in p)]
            if len(known) == len(paths):
                assert np.allclose(scores, [score(p) for p in paths])
                assert np.allclose(scores, [score(p) for p in lattice], atol=1e-3)
            assert len(paths) == len({tuple(p) for p in paths}) and scores == sorted(scores, reverse=True)
        assert math.isclose(sum(0 if math.isnan(vocab.scores[i]) else vocab.scores[i] for i in mine), sum(0 if math.isnan(vocab.scores[i]) else vocab.scores[i] for i in want), abs_tol=1e-3)


def test_word_search_against_all_paths(vocab):
    def every(word):
        if not word:
            return [(0.0, ())]
        out = []
        for end in range(1, len(word) + 1):
            i = vocab.ids.get(word[:end])
            if i is not None:
                out += [(vocab.scores[i] + s, (i, *p)) for s, p in every(word[end:])]
        return out

    for word in ["▁thereand", "▁stone", "indeed", "▁a"]:
        paths = sorted(every(word), key=lambda p: -p[0])
        found = nbest.best_paths(vocab, word, 6)
        assert np.allclose([paths[0][0] - loss for loss, _ in found], [s for s, _ in paths[:6]])
        best, gap, ids, _ = nbest.viterbi(vocab, [word])
        assert tuple(np.frombuffer(ids[0], np.int32)) == found[0][1] and (len(found) < 2 or math.isclose(gap[0], found[1][0], abs_tol=1e-9))


def test_small_memory_gives_the_same(vocab):
    big, small = nbest.Encoder(vocab, 3), nbest.Encoder(vocab, 3, kept=5)
    for text in texts():
        words = big.words(text or "")
        if words:
            big.learn([words])
            small.learn([words])
            assert big.encode(words) == small.encode(words)


def test_long_words_as_side_by_side(vocab, monkeypatch):
    r = random.Random(3)
    words = ["x" * 700, "ab" * 300, "中文字" * 120, "".join(r.choice("theandionr中𐐀") for _ in range(900)), "▁" + "-" * 500]
    together = nbest.viterbi(vocab, words)
    monkeypatch.setattr(nbest, "LONG", 10)
    alone = nbest.viterbi(vocab, words)
    assert together[0].tolist() == alone[0].tolist() and together[1].tolist() == alone[1].tolist()
    assert together[2] == alone[2] and sorted(together[3]) == sorted(alone[3])
    for word, best, gap in zip(words, *alone[:2]):
        found = nbest.best_paths(vocab, word, 3)
        assert [loss for loss, _ in found][:2] == [0.0, gap][: len(found)] and (len(found) > 1) == (gap < math.inf)
        assert all(sum(vocab.unknown if i < 0 else vocab.scores[i] for i in path) == best - loss for loss, path in found)


def test_texts_without_spaces(spark, vocab):
    r = random.Random(5)
    rows = [(1, "x" * 300_000, None), (2, "x" * 299_999, None), (3, "".join(r.choice("abcdefgh中文") for _ in range(200_000)), None)]
    coded = nbest.encode(spark.createDataFrame(rows, SCHEMA), vocab, carry=["doc_id", "text"])
    for row in nbest.decode(coded, vocab).collect():
        assert row.decoded == row.text and len(row.scores) == 4
        assert row.scores == sorted(row.scores, reverse=True)
        (change,) = row.others[0]
        assert (change.at, change.many) == (0, len(row.ids)) and list(change.ids) != list(row.ids)


def test_kept_characters_are_bounded(vocab, monkeypatch):
    monkeypatch.setattr(nbest, "KEPT_CHARACTERS", 5_000)
    encoder = nbest.Encoder(vocab, 2)
    for i in range(20):
        words = encoder.words("y" * 2_000 + str(i) + " the cat")
        encoder.learn([words])
        encoder.encode(words)
    assert encoder.held <= 6_100 and encoder.held == sum(map(len, encoder.known)) and not any(len(w) > nbest.LONG for w in encoder.paths)


def test_table_grows_with_the_vocabulary():
    keys, values = nbest._cuckoo({nbest._piece_hash(f"piece{i}"): i for i in range(300_000)})
    assert len(keys) >= 800_000 and (values >= 0).sum() == 300_000


def test_round_trip(spark, vocab):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(0, "Hello world", "clash")]
    df = spark.createDataFrame(rows, SCHEMA)
    coded = nbest.encode(df, vocab, carry=["doc_id", "text"])
    out = nbest.decode(coded, vocab).collect()
    assert len(out) == len(rows) and all(r.decoded == (r.text or "") for r in out)
    assert {len(r.scores) for r in out if r.text == "Hello world"} == {4}
    assert nbest.encode(spark.createDataFrame([], SCHEMA), vocab).collect() == []
    assert nbest.encode(df, vocab).columns == ["doc_id", "ids", "scores", "others"]


def test_decoding_hands_on_small_batches(spark, vocab, monkeypatch):
    """A batch of long texts comes back in parts, so that neither side holds it whole."""
    kept = {}
    monkeypatch.setattr(nbest, "map_arrow", lambda df, run, kinds: kept.setdefault("run", run) and df)
    monkeypatch.setattr(nbest, "PIECES", 10, raising=False)
    nbest.decode(spark.createDataFrame([], "row int, ids array<int>"), vocab)
    lists = [vocab_ids(vocab, 8) for _ in range(6)] + [None, []]
    batch = pa.record_batch([pa.array(range(8), pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["row", "ids"])
    parts = list(kept["run"](batch))
    assert len(parts) > 3 and max(p.num_rows for p in parts) <= 3
    assert [x for p in parts for x in p.column("row").to_pylist()] == list(range(8))
    texts = [x for p in parts for x in p.column("decoded").to_pylist()]
    assert texts[6] is None and texts[7] == "" and len(set(texts[:6])) == 1


def vocab_ids(vocab, n):
    return [i for i, p in enumerate(vocab.pieces) if i in set(vocab.ids.values())][:n]
