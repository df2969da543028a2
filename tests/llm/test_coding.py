"""SentencePiece coding, packing, chat formatting and audio against their libraries and exact round trips."""

import hashlib
import io
import random
import wave
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumengrid.llm import chat, media, packing, sentencepiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return sorted(df.collect(), key=repr)


def test_sentencepiece_equals_the_library(odd, documents):
    import sentencepiece as library

    own = library.SentencePieceProcessor(model_file=MODEL)
    docs = odd.select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    got = sentencepiece.decode(sentencepiece.encode(docs, MODEL), MODEL)
    want = []
    for r in docs.collect():
        ids = own.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, np.array(ids, "<u4").tobytes(), own.decode(ids)))
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_sentencepiece_decodes_any_ids(spark):
    import sentencepiece as library

    own = library.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(1)
    runs = [[r.choice([0, 1, 2, 13, 29871, r.randrange(3, 32000)]) for _ in range(r.randint(0, 12))] for _ in range(300)]
    runs = [[i for i in run if not 3 <= i < 259] for run in runs]  # bytes alone need not be UTF-8
    df = spark.createDataFrame([(i, np.array(run, "<u4").tobytes()) for i, run in enumerate(runs)], "doc_id long, ids binary")
    got = {x.doc_id: x.decoded for x in sentencepiece.decode(df, MODEL).collect()}
    assert got == {i: own.decode(run) for i, run in enumerate(runs)}


def test_sentencepiece_empty(empty):
    assert sentencepiece.decode(sentencepiece.encode(empty, MODEL), MODEL).columns == ["doc_id", "ids", "decoded"]
    assert sentencepiece.encode(empty, MODEL).count() == 0


def test_packing(odd, documents):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = odd.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(documents.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    pieces = packing.packed_documents(docs).collect()
    want = {r.doc_id: [*own.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    of_doc, of_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_seq[p.sequence_id].append((p.offset, p.length))
    assert of_doc.keys() == want.keys()
    for doc, ids in want.items():
        own_pieces = sorted(of_doc[doc], key=lambda p: p.piece)
        assert [p.piece for p in own_pieces] == list(range(len(own_pieces)))
        assert len(own_pieces) == -(-len(ids) // 2048)
        at = 0
        for p in own_pieces:
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own_places in of_seq.values():
        at = 0
        for offset, length in sorted(own_places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(of_seq) == len(best_fit(sorted((p.length for p in pieces), reverse=True)))


def best_fit(lengths):
    gaps = []
    for n in lengths:
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            i = min(fits, key=gaps.__getitem__)
            gaps[i] -= n
        else:
            gaps.append(2048 - n)
    return gaps


@pytest.mark.parametrize("seed", range(20))
def test_packing_rounds_equal_best_fit(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 50), r.randint(1, 10)]) for _ in range(r.randint(0, 300))]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    placed = packing.rounds(counts, 50)
    used = defaultdict(list)
    for length, rank, count, first, offset in placed:
        for k in range(count):
            used[first + k].append((offset, length))
    assert sum(len(v) for v in used.values()) == len(lengths)
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 50
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= n
        else:
            gaps.append(50 - n)
    assert len(used) == len(gaps)


@pytest.mark.parametrize("groups", [1 << 16, 7])
def test_packing_ranks_hot_lengths_in_groups(spark, monkeypatch, groups):
    """A length of many rows is ranked in groups by its count, and places are those of one group."""
    r = random.Random(4)
    lengths = [2048] * 900 + [500] * 400 + [r.randint(1, 1500) for _ in range(300)]
    rows = [(i // 3, i % 3, n, i * 7919 % 65537) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long").repartition(5)
    monkeypatch.setattr(packing, "RANKED", 40)
    monkeypatch.setattr(packing, "GROUPS", groups)
    got = packing.pack(pieces).collect()
    assert sorted((p.doc_id, p.piece, p.length, p.ids_crc32) for p in got) == sorted(rows)
    of_seq = defaultdict(list)
    for p in got:
        of_seq[p.sequence_id].append((p.offset, p.length))
    for own in of_seq.values():
        assert [a for a, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1]] and sum(n for _, n in own) <= 2048
    assert len(of_seq) == len(best_fit(sorted(lengths, reverse=True)))


def test_packing_odd_tables(odd, empty):
    assert packing.packed_documents(empty).count() == 0
    assert packing.packed_documents(odd).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def test_chat_equals_sql(same):
    same(chat.query, chat.SQL)


def test_chat_round_trip(spark, texts):
    r = random.Random(2)
    talks = [(c, t, r.choice(["user", "assistant", "tool\nx", "a\\n<|", None]), r.choice([*texts, None])) for c in range(80) for t in range(r.randint(1, 5))]
    talks += [(None, 0, "assistant", "no id"), (3, None, "user", "first of all")]
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(df.withColumn("parts", chat.text_parts(F.col("text")))).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask")))
    want = defaultdict(list)
    for c, t, role, text in sorted(talks, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0)):
        want[c].append((role or "", text or ""))
    got = {x.conv_id: x for x in done.collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].back] == turns
        assert got[c].loss == "".join(text for role, text in turns if role == "assistant")


def test_chat_attachments(spark):
    parts = [("text", "see <|image:0|> ", None, None), ("image", None, "a.png", 2.0), None, ("video", None, "v", 1.0), ("audio", None, "b.wav", 0.5)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("document", None, "c.pdf", None), ("text", "done", None, None)]), (2, 0, "user", None)], f"conv_id long, turn long, role string, parts {chat.PART}")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert got[1].formatted == "<|im_start|>user\nsee <\\|image:0|> <|image:0|><|audio:1|><|im_end|>\n<|im_start|>assistant\n<|document:2|>done<|im_end|>\n"
    assert [tuple(a) for a in got[1].attachments] == [(0, "image", "a.png", 512), (1, "audio", "b.wav", 13), (2, "document", "c.pdf", 600)]
    assert got[1].expanded_tokens == 1125
    assert [tuple(s) for s in got[1].loss_mask] == [(got[1].formatted.index("<|document"), len(got[1].formatted) - len("<|im_end|>\n"))]
    assert got[2].formatted == "<|im_start|>user\n<|im_end|>\n"
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_is_native(spark, sf_dir, capsys):
    chat.query(spark, sf_dir).explain()
    assert "Python" not in capsys.readouterr().out


def test_media(odd, documents):
    docs = odd.select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    done = media.audio_features(media.store_audio(docs)).collect()
    want = sorted((repr(r.doc_id), (r.text or "").encode()) for r in docs.collect())
    got = []
    seen = {}
    for r in done:
        payload = bytes(r.payload)
        assert len(payload) % 192 == 0 and len(payload) >= 192
        assert payload[r.n_bytes :].strip(b" ") == b"" and len(payload) - r.n_bytes <= 192
        with wave.open(io.BytesIO(bytes(r.media))) as f:
            assert f.readframes(f.getnframes()) == payload
        assert seen.setdefault(payload, (r.media, r.tensors, r.feature)) == (r.media, r.tensors, r.feature)
        tensor = pa.ipc.open_stream(bytes(r.tensors)).read_all().column("log_mel").combine_chunks()
        assert tensor.type.shape == [media.WINDOW, media.MELS] and len(tensor) == len(r.windows)
        assert all(s.start < s.stop for s in [*r.windows, *r.segments])
        got.append((repr(r.doc_id), payload[: r.n_bytes]))
    assert sorted(got) == want


def test_media_query_digests(spark, sf_dir, documents):
    got = {r.doc_id: r for r in media.query(spark, sf_dir).collect()}
    for r in documents.collect():
        raw = (r.text or "").encode()
        raw = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert got[r.doc_id].payload_sha256 == hashlib.sha256(raw).hexdigest() and got[r.doc_id].payload_bytes == len(raw)
        assert got[r.doc_id].tail_crc32 == zlib.crc32(raw[-16:])


def test_media_tone():
    """A tone's energy lies in its mel band, and resampling keeps its frequency."""
    n = np.arange(24_000)
    y = media.resample(np.sin(2 * np.pi * 1000 * n / 24_000).astype(np.float32))
    assert len(y) == 16_000 and np.argmax(np.abs(np.fft.rfft(y))) == 1000
    mels, _ = media.log_mel(y)
    centre = 2595 * np.log10(1 + 1000 / 700)
    edges = np.linspace(2595 * np.log10(1 + 20 / 700), 2595 * np.log10(1 + 8000 / 700), media.MELS + 2)
    assert abs(int(mels.mean(axis=0).argmax()) + 1 - int(np.abs(edges - centre).argmin())) <= 1
    assert media.segments(np.array([0, 0, 5, 3, 5, 0, 0, 5.0])).tolist() == [[2, 5], [7, 8]]


def test_media_empty(empty):
    assert media.audio_features(media.store_audio(empty)).count() == 0


def test_chat_null_turns_as_in_sql(spark, tmp_path):
    """Turns without a number come first, in the query and in its text."""
    import duckdb

    rows = [(1, 2, "assistant", "b"), (1, None, "user", "a"), (1, None, "assistant", "z"), (1, 0, None, None), (2, None, "assistant", "<|im_end|>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    df = chat.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(chat.SQL)
    columns = sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(want.select(", ".join(columns)).fetchall())
