"""Audio, WARC bundles, chat texts, byte pairs and token files: round trips and scalar versions."""

import base64
import os
import random
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from sparrowtext.llm import audio, bpe, chat, token_store, warc
from sparrowtext.llm._text import chunks

tiktoken = pytest.importorskip("tiktoken")
VOCABULARY = bpe.default_vocabulary()
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def scalar_adpcm(data, block):
    out = []
    for at in range(0, len(data), block):
        b = data[at : at + block]
        if len(b) < 4:
            break
        value, index = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(value)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                d = step >> 3
                d += step if code & 4 else 0
                d += step >> 1 if code & 2 else 0
                d += step >> 2 if code & 1 else 0
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                out.append(value)
    return out


def scalar_mulaw(b):
    b = ~b & 0xFF
    t = ((b & 15) * 2 + 33 << (b >> 4 & 7)) - 33
    return (-t if b & 128 else t) * 4


def scalar_alaw(b):
    b ^= 0x55
    e, m = b >> 4 & 7, b & 15
    t = 2 * m + 1 if e == 0 else 2 * m + 33 << e - 1
    return (t if b & 128 else -t) * 8


def test_tables():
    assert audio.TABLES["mulaw"].tolist() == [scalar_mulaw(b) for b in range(256)]
    assert audio.TABLES["alaw"].tolist() == [scalar_alaw(b) for b in range(256)]


def test_adpcm():
    rnd = random.Random(2)
    clips = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 3, 4, 5, 63, 64, 65, 67, 68, 300, 640)]
    off = np.concatenate([[0], np.cumsum([len(c) for c in clips])])
    want = [scalar_adpcm(c, 64) for c in clips]
    got = audio.decode_adpcm(np.frombuffer(b"".join(clips), np.uint8), off, 64)
    assert got.tolist() == [x for w in want for x in w]
    assert audio.adpcm_samples(np.diff(off), 64).tolist() == [len(w) for w in want]


def test_resample():
    t = np.arange(800)
    tone = np.rint(9000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    both = np.concatenate([tone, tone[:5], tone[:0]])
    up, sizes = audio.resample(both, np.array([800, 5, 0]))
    assert sizes.tolist() == [1600, 10, 0] and up[:1600:2].tolist() == tone.tolist()
    ideal = 9000 * np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert np.abs(up[40:1560] - ideal[40:1560]).max() < 120
    down, sizes = audio.resample(up[:1600], np.array([1600]), 16000, 8000)
    assert sizes.tolist() == [800] and np.abs(down[40:760] - tone[40:760]).max() < 400
    alone, _ = audio.resample(tone[:5], np.array([5]))
    assert up[1600:].tolist() == alone.tolist()
    odd, sizes = audio.resample(tone, np.array([800]), 8000, 11025)
    assert sizes.tolist() == [1103] and np.abs(odd[50:1050] - 9000 * np.sin(2 * np.pi * 440 * np.arange(1103) / 11025)[50:1050]).max() < 300


def test_clips(spark):
    rows = [(1, "mulaw", b"\x00\xff\x80"), (2, "alaw", b"\x01\x02"), (3, "ima_adpcm", bytes(range(200)) * 3), (4, "mulaw", None), (5, None, b"x"), (6, "g729", b"x"), (7, "alaw", b""), (1, "mulaw", b"\x00\xff\x80"), (None, "mulaw", b"a"), (8, "mulaw", bytes(3_000_000))]
    df = spark.createDataFrame(rows, "id bigint, codec string, audio binary").withColumn("pcm", F.lit(1)).withColumn("rate", F.lit("x"))
    got = audio.decoded(df, ("id",)).collect()
    assert len(got) == len(rows)
    for r in got:
        row = next(x for x in rows if x[0] == r.id)
        if row[2] is None or row[1] not in ("mulaw", "alaw", "ima_adpcm"):
            assert r.pcm is None and r.n_samples is None
            continue
        pcm = np.frombuffer(r.pcm, "<i2")
        plain = scalar_adpcm(row[2], audio.BLOCK) if row[1] == "ima_adpcm" else [(scalar_mulaw if row[1] == "mulaw" else scalar_alaw)(b) for b in row[2]]
        assert r.n_samples == len(pcm) == 2 * len(plain) and pcm[::2].tolist() == plain and r.rate == 16000
    assert audio.decoded(df.limit(0), ("id",)).collect() == []


def test_warc(spark):
    rows = [(i, f"http://x/{i}", f"<p>{'é' * (i * 37 % 900)}</p>") for i in range(300)] + [(5, "http://x/5", "<p>again</p>"), (None, None, None), (7, "http://x/7", ""), (8, "a\r\nb", "z" * 400_000), (5, "http://x/5", "<p>again</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("bundle", F.lit(1)).repartition(2)
    made = warc.bundles(df, frame_bytes=4096, bundle_bytes=60_000).cache()
    index = {}
    assert made.count() > 3
    for b in made.collect():
        table = warc.seek_table(b.bundle)
        assert len(table) == b.n_frames and sum(x[2] for x in table) == b.raw_bytes
        whole = b"".join(zstandard.ZstdDecompressor().decompress(b.bundle[a : a + n], max_output_size=size) for a, n, size in table)
        assert zstandard.ZstdDecompressor().stream_reader(b.bundle, read_across_frames=True).read() == whole
        for p in b.records:
            raw = warc.read_frame(b.bundle, p.frame)[p.offset : p.offset + p.length]
            fields, body = warc.parse_record(raw)
            assert fields["WARC-Record-ID"] == f"<{p.record_id}>"
            index.setdefault(p.record_id, []).append((p.page_id, fields["WARC-Target-URI"], body.decode()))
    want = sorted(((i, (u or "").replace("\r", "%0D").replace("\n", "%0A"), h or "") for i, u, h in rows), key=str)
    assert sorted((x for v in index.values() for x in v), key=str) == want
    assert warc.record_index(made).count() == len(rows)
    some = [k for k, v in index.items() if v[0][0] in (3, 250)]
    got = warc.fetch(made, some).collect()
    assert {(r.record_id, r.page_id) for r in got} == {(k, index[k][0][0]) for k in some}
    assert warc.bundles(df.limit(0)).collect() == [] and warc.fetch(made, []).collect() == []


def test_chat(spark):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant", "system"]), "".join(rnd.choice("aé\n<|im_end|>") for _ in range(rnd.randint(0, 40)))) for c in range(40) for t in range(rnd.randint(1, 6))]
    rows += [(100, None, "user", "first"), (100, 0, None, None), (101, 1, "assistant", "b"), (101, 1, "assistant", "a"), (101, 1, "assistant", "a"), (None, 0, "user", "lost"), (102, 0, "assistant", "long " * 200_000), (103, 0, "user", "<|im_start|>system")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("spans", F.lit(1)).withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert set(got) == {r[0] for r in rows if r[0] is not None}
    for conv, r in got.items():
        own = sorted(((x[1] if x[1] is not None else -1, x[2] or "", (x[3] or "").replace("<|im_", "<| im_")) for x in rows if x[0] == conv))
        text, spans = "", []
        for _, role, content in own:
            text += f"<|im_start|>{role}\n"
            start = len(text.encode())
            text += content
            if role == "assistant":
                spans.append((start, len(text.encode())))
            text += "<|im_end|>\n"
        assert r.text == text and r.n_turns == len(own) and [(s.start, s.end) for s in r.spans] == spans
    assert chat.formatted(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_exact(reference):
    coder = bpe.Bpe(bpe.read_ranks(VOCABULARY))
    rnd = random.Random(6)
    alphabet = "abcdeeeetthhs 's't're'll'm ' 0123  \n\n\t\r!?.,éüñ中文🙂 　Ⅷ²'DŚ\x00"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(3000)]
    texts += ["", "a" * 2000, " " * 50, "\n", " \n ", "it's they'll 's ''s x's I'M don't!'t", "e" * 63 + "é", "<|endoftext|>"]
    array = pa.array(texts)
    for a, b in chunks(array, 20_000):
        ids, off = coder.encode(array[a:b])
        for k in range(a, b):
            assert ids[off[k - a] : off[k - a + 1]].tolist() == reference.encode_ordinary(texts[k]), texts[k]
        data, at = coder.decode(ids, off)
        assert [data[at[i] : at[i + 1]].tobytes().decode() for i in range(b - a)] == texts[a:b]
    with pytest.raises(ValueError):
        bpe.Bpe([b"a", b"b"])


def test_bpe_frames(spark, reference):
    long = "word salad, " * 60_000
    rows = [(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (None, "x"), (4, long)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    got = bpe.encoded(df, VOCABULARY).cache()
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=str) == sorted(((i, None if t is None else reference.encode_ordinary(t)) for i, t in rows), key=str)
    assert all(r.round_trip is (None if r.ids is None else True) and r.n_tokens == (None if r.ids is None else len(r.ids)) for r in got.collect())
    back = bpe.decoded(got, VOCABULARY).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(rows, key=str)
    assert bpe.encoded(df.limit(0), VOCABULARY).collect() == []


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_store(spark, tmp_path, reference, encoding):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "sat", "éclair", "on", "12"]) for _ in range(rnd.randint(0, 300))), rnd.choice(["a", "b"]), "en") for i in range(400)]
    rows += [(None, "no id", None, "en"), (7, None, "a", None), (7, "", "a", "en"), (7, "", "a", "en"), (9000, "tok " * 100_000, "c", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("file", F.lit(1)).withColumn("tokens", F.lit(2)).repartition(3)
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    manifest = token_store.write_tokens(df, VOCABULARY, path, encoding, row_group_tokens=5000)
    assert manifest.count() == len(rows)
    want = sorted(((i, None if t is None else reference.encode_ordinary(t), s) for i, t, s, _ in rows), key=str)
    got = token_store.read_tokens(spark, path, manifest, ("doc_id", "tokens", "source"))
    assert sorted(((r.doc_id, r.tokens, r.source) for r in got.collect()), key=str) == want
    few = token_store.read_tokens(spark, path, manifest, ("doc_id", "n_tokens"), [3, 9000])
    assert {r.doc_id: r.n_tokens for r in few.collect()} == {i: len(t) for i, t, _ in want if i in (3, 9000)}
    assert ",tokens:" not in few._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    folder = path[len("file://") :]
    for r in manifest.select("file").distinct().collect():
        meta = pq.ParquetFile(os.path.join(folder, r.file)).metadata
        assert meta.num_row_groups > 1
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and column.has_column_index
                if column.path_in_schema.startswith("tokens"):
                    assert ("DELTA_BINARY_PACKED" if encoding == "delta" else "RLE_DICTIONARY") in column.encodings
    place = manifest.where("doc_id = 3").first()
    table = pq.ParquetFile(os.path.join(folder, place.file)).read_row_group(place.row_group)
    assert table.column("doc_id")[place.row].as_py() == 3
    assert token_store.write_tokens(df.limit(0), VOCABULARY, path + "-none").collect() == []
    with pytest.raises(ValueError):
        token_store.write_tokens(df, VOCABULARY, path, "plain")
