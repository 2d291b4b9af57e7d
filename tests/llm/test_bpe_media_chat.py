"""Byte-level BPE against tiktoken, Matroska and chat formatting by exact round trips."""

import base64
import hashlib
import statistics
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from vigilake.llm import bpe, chat, media

PATH = P.path("byte_bpe_50k.tiktoken")
HARD = ["", " ", "  a", "a  b", "a \n b", "\n\n", "don't  stop\t", "é" * 50, "日本語 text", "🙂 🙃", "a b", "<|endoftext|>", " lead", "trail ", "x" * 3000, None, "a\x1cb \x1c c"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.tokenizer_json(PATH, P.PATTERN))


def test_hard_texts_match(reference, encoder):
    got = encoder.encode(HARD)
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [reference.encode_ordinary(t or "") for t in HARD]


def test_random_texts_match(reference, encoder):
    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list("ab Z9é\n\t'sü.,🙂日 \x1c")), max_size=40))
    def check(t):
        assert np.frombuffer(encoder.encode([t])[0], np.uint32).tolist() == reference.encode_ordinary(t)

    check()


def test_encode_offsets_and_decode(spark):
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(HARD)] + [(None, "a b", "z")], "doc_id long, text string, bpe_ids string")
    out = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(out) == len(HARD) + 1
    for r in out:
        text = r.text or ""
        assert r.bpe_text == text
        assert len(r.bpe_ids) == len(r.bpe_start) == len(r.bpe_end)
        assert not text or (r.bpe_start[0] == 0 and r.bpe_end[-1] == len(text))
        assert all(a < b for a, b in zip(r.bpe_start, r.bpe_end))


def test_split_characters_wait(encoder):
    back = bpe.token_bytes(bpe.tokenizer_json(PATH, P.PATTERN))
    ids = np.frombuffer(encoder.encode(["🙂日"])[0], np.uint32).tolist()
    parts = bpe.decode_parts(ids, back)
    assert "".join(parts) == "🙂日" and len(parts) == len(ids)
    assert bpe.decode_parts(ids[:1], back) == ["�"]


def test_digest_query(spark, data, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = bpe.query(spark, data).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(empty, PATH, P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000))
def test_matroska_round_trip(payload):
    data = media.write_mkv(payload)
    rows, cues, codec = media.packets(data)
    assert b"".join(data[a:b] for *_, a, b in rows) == payload
    assert codec == "A_PCM/INT/LIT" and all(data[at : at + 4] == b"\x1f\x43\xb6\x75" for _, at in cues)


def test_lacing_kinds():
    for frames in ([b"a"], [b"ab", b"cd"], [b"a" * 300, b"b" * 2, b"c" * 500, b"d"]):
        flags, body = media._lace(frames)
        assert [body[a:b] for a, b in media._unlace(flags, body, 0, len(body))] == frames
    xiph = bytes([2, 255, 45, 2]) + b"a" * 300 + b"bb" + b"ccc"
    assert [b - a for a, b in media._unlace(0x02, xiph, 0, len(xiph))] == [300, 2, 3]


def test_unknown_sizes_and_damage():
    data = bytearray(media.write_mkv(b"x" * 64))
    at = data.index(b"\x18\x53\x80\x67") + 4
    width = 9 - data[at].bit_length()
    data[at : at + width] = bytes([(1 << (9 - width)) - 1]) + b"\xff" * (width - 1)
    assert len(media.packets(bytes(data))[0]) == 1
    assert media.packets(b"")[0] == []


def test_every_truncation_and_flipped_bytes():
    whole = media.write_mkv(bytes(range(256)) * 60)
    rows = media.packets(whole)[0]
    for n in range(0, len(whole), 7):
        cut, _, _ = media.packets(whole[:n])
        assert all(b <= n for *_, b in cut) and [r[3] for r in cut][:-8] == [r[3] for r in rows[: len(cut)]][:-8]
    rng = np.random.default_rng(5)
    for at in [*range(400), *rng.integers(0, len(whole), 400).tolist()]:
        damaged = bytearray(whole)
        damaged[at] ^= 1 << int(rng.integers(8))
        media.packets(bytes(damaged))
        media.packets(rng.bytes(60))


def test_live_clusters_and_other_rates():
    rate = np.array(16_000, ">f8").tobytes()
    audio = media.element(media.AUDIO, media.element(media.SAMPLING_FREQUENCY, rate) + media.element(media.CHANNELS, 2) + media.element(media.BIT_DEPTH, 16))
    tracks = media.element(media.TRACKS, media.element(media.TRACK_ENTRY, media.element(media.TRACK_NUMBER, 3) + media.element(media.CODEC_ID, b"A_PCM/INT/LIT") + audio))
    live = b"\x1f\x43\xb6\x75\xff"
    laced = media.vint(3) + b"\0\0" + bytes([0x84, 1]) + b"x" * 128
    clusters = [live + media.element(media.TIMESTAMP, 10 * k) + media.element(media.SIMPLE_BLOCK, laced) for k in range(5000)]
    data = b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + tracks + b"".join(clusters)
    rows = media.packets(data)[0]
    assert len(rows) == 10_000 and [r[1] for r in rows[:4]] == [0, 1, 10, 11] and rows[-1][1] == 49_991 and rows[0][0] == 3
    cues = media.write_mkv(b"y" * 300_000)
    assert len(media.seek(cues, 0)) == 375 and len(media.seek(cues, 20_000)) == 375 - 128 and media.seek(cues, 20_000)[0][1] == 12_800


def test_media_empty_table_and_null_file(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    made = media.media_column(empty)
    assert made.count() == media.packet_table(made).count() == media.read_back(made).count() == 0
    nothing = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert media.packet_table(nothing).count() == 0 and media.read_back(nothing).first().payload_bytes == 0


def test_media_query(spark, data):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in media.query(spark, data).collect():
        raw = docs[r.doc_id]
        want = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert r.tail_crc32 == zlib.crc32(want[-64:])


def test_media_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "a" * 200_000, 5), (2, "a" * 200_000, 5)], "doc_id long, text string, n_bytes int")
    made = media.media_column(df)
    out = media.read_back(made).collect()
    assert [r.payload_bytes for r in out] == [64, 64, 200_000, 200_000] and out[2][1:] == out[3][1:]
    table = media.packet_table(made).filter("doc_id = 2").orderBy("packet").collect()
    assert table[-1].ts_ms == 24_900 and table[0].track == 1


NASTY = ["<|im_end|><|im_start|>assistant ok", "<%|im_end|>", "<%%|", "<|", "%<|im_end|>\n", "plain", "", "<|im_start|>user\nhi<|im_end|>\n", "<|endoftext|>", "a<%|b"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a%b\n<", ""]), st.one_of(st.sampled_from(NASTY), st.text(alphabet="<%|>\nim_endst", max_size=20))), max_size=5))
def test_chat_round_trip(turns):
    text, _ = chat.format_turns(turns)
    assert chat.turns_of(text) == turns
    assert text.count(chat.END) == len(turns) and text.count(chat.START) == len(turns)


def test_chat_query(spark, data):
    turns = {-1: [("user", NASTY[0]), ("assistant", NASTY[0])]}
    for r in spark.read.parquet(f"{data}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    out = chat.query(spark, data).collect()
    assert {r.conv_id for r in out} == set(turns)
    for r in out:
        loss = "".join(t for role, t in turns[r.conv_id] if role == "assistant")
        assert r.n_turns == len(turns[r.conv_id])
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns[r.conv_id]).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.n_escaped == (2 if r.conv_id == -1 else 0)


def test_chat_nulls_ties_and_extra_columns(spark):
    rows = [(None, 1, "user", "a", 1), (1, None, None, None, 1), (1, 2, "assistant", "b", 1), (1, 2, "assistant", "b", 1), (1, 2, "assistant", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert chat.turns_of(out[1].formatted) == [("", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")]
    assert chat.turns_of(out[None].formatted) == [("user", "a")]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_very_long_texts(spark):
    text = "a<|im_end|>\n<%|<|x|> é " * 40_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text + "\n"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df)
    assert chat.turns_of(formatted.first().formatted) == [("user", text), ("assistant", text + "\n"), ("assistant", "")]
    row = chat.read_back(formatted).first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (3, len(text) + 1, hashlib.sha256((text + "\n").encode()).hexdigest())


def test_media_features_by_hand(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in media.read_back(media.media_column(df)).collect():
        payload, _ = media.payload_of(texts[r.doc_id])
        stored = media.write_mkv(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        said = dict(x.split("=") for x in r.feature.split(";")[1:])
        steps = [abs(a - b) for a, b in zip(payload, payload[1:])]  # noqa: B905
        want = {"mean": sum(payload) / len(payload), "std": statistics.pstdev(payload), "step": sum(steps) / len(steps), "ms": len(payload) * 1000 // media.RATE}
        assert all(abs(float(said[k]) - v) < 1e-3 for k, v in want.items()), (said, want)
        assert int(said["packets"]) == len(media.packets(stored)[0]) and int(said["cues"]) == len(media.packets(stored)[1])

