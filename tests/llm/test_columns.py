"""Media columns, token files, BPE, sharding and lines."""

import hashlib
import os
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioscope.llm import media, shards
from folioscope.llm.bpe import bpe, encoded, op10_bpe, round_trips
from folioscope.llm.lines import LineRuns, cleaned, line_hashes, without_repeated_lines
from folioscope.llm.tokens import VOCABULARY, library_encoder, op9_token_files, read_ids, tokenizer, write_ids

PATH = public_tokenizers.path(VOCABULARY)
ODD = [
    "", " ", "a", " a", "a ", "  a", "a  b", "a \n b", "a\n\n b", "<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>  x", "aaaaaaaa aaaa", "don't 'll we're", "ÀÉ ü x  y", "日本 語", "x\u0085 y",
    "🙂🙂 a", "١٢٣ ½", "a\tb \t c", "\r\n a", "word " * 300, "x" * 5000,
]
SCHEMA = "doc_id long, text string, _id string, lines int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1417, 1418, 5000, 70000])
def test_streams_hold_any_bytes(n):
    data = os.urandom(n)
    stream = media.wrap(data)
    found = media.scan(stream)
    size, payload = media.unwrap(stream, found)
    assert size == n and payload == data.ljust(len(payload), b"\0") and len(payload) % 64 == 0
    assert found["crc_bad"] == found["skipped"] == 0 and found["vbr"][:2] == ("Xing", len(found["offsets"]))
    assert found["vbr"][2] == len(stream) - found["offsets"][0] - 128 + media.SIZES[0]
    assert found["samples"] == 1152 * len(found["offsets"]) and found["rate"] == 32000


def test_resynchronisation_and_bad_checksums():
    stream = media.wrap(b"payload" * 900)
    found = media.scan(stream)
    cut = stream[: found["offsets"][1]] + b"\xff\xfa junk \xff" + stream[found["offsets"][1] :]
    again = media.scan(cut)
    assert len(again["offsets"]) == len(found["offsets"]) and again["skipped"] == 9
    broken = bytearray(stream)
    broken[found["offsets"][0] + 7] ^= 1
    assert media.scan(bytes(broken))["crc_bad"] == 1
    assert media.scan(b"no audio at all")["offsets"] == []
    assert media.scan(b"") ["samples"] == 0


def frame(index, rate, size=None, layer_byte=0xFB, pad=0):
    """A silent mono frame; index 0 is free format, of so many bytes."""
    head = bytes([0xFF, layer_byte, index << 4 | rate << 2 | pad << 1, 0xC0])
    return head.ljust((size or media.header(head, 0)[6]) + (pad if size else 0), b"\0")


def test_durations_of_mixed_rates():
    """10 frames at 44.1 kHz and 10 at 32 kHz, then 3 of MPEG-2 at 22.05 kHz."""
    data = frame(9, 0) * 10 + frame(9, 2) * 10 + frame(8, 0, layer_byte=0xF3) * 3
    found = media.scan(data)
    assert len(found["offsets"]) == 23 and found["skipped"] == 0 and found["samples"] == 20 * 1152 + 3 * 576
    assert found["seconds"] == Fraction(11520, 44100) + Fraction(11520, 32000) + Fraction(1728, 22050)


def test_durations_in_the_catalog(spark):
    data = frame(9, 0) * 10 + frame(9, 2) * 10
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"")), (None, None)], "doc_id long, media binary")
    got = {r["doc_id"]: (r["duration_us"], r["sample_rate"], r["n_frames"]) for r in media.catalog(rows).collect()}
    assert got == {1: (int(Fraction(11520, 44100) * 10**6 + Fraction(11520, 32000) * 10**6), 44100, 20), 2: (0, 0, 0), None: (0, 0, 0)}


@pytest.mark.parametrize("size", [101, 800, 2000])
def test_frames_of_free_format(size):
    own = [frame(0, 0, size, pad=k % 3 == 0) for k in range(12)]
    data = b"junk\xff\xfb" + b"".join(own) + frame(9, 0) * 3
    found = media.scan(data)
    assert found["skipped"] == 6 and found["samples"] == 15 * 1152
    assert found["offsets"][:12] == [6 + sum(map(len, own[:k])) for k in range(12)]
    assert media.scan(frame(0, 0, size))["offsets"] == []  # one alone has no length


def test_headers_of_other_layers():
    assert media.header(bytes([0xFF, 0xFB, 0x90, 0x00]), 0)[6] == 417  # 128 kbit/s, 44.1 kHz
    assert media.header(bytes([0xFF, 0xF3, 0x80, 0x00]), 0)[6:8] == (208, 576)  # MPEG-2 Layer III, 64 kbit/s, 22.05 kHz
    assert media.header(bytes([0xFF, 0xFF, 0x10, 0x00]), 0)[6:8] == (32, 384)  # Layer I, 32 kbit/s
    assert media.header(bytes([0xFF, 0xFB, 0xF0, 0x00]), 0) is None and media.header(b"\xff", 0) is None


def test_media_table(spark):
    rows = [(1, "text ü"), (None, None), (2, ""), (1, "text ü"), (3, "long " * 20000)]
    got = media.catalog(media.as_audio(table(spark, rows))).collect()
    want = Counter()
    for i, t in rows:
        data = (t or "").encode()
        data = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        want[i, len((t or "").encode()), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert media.catalog(media.as_audio(table(spark, []))).count() == 0


def test_encoders_equal_the_library():
    t = tokenizer(PATH)
    rng = np.random.default_rng(0)
    parts = ["a", "b", " ", "  ", "\n", "é", "🙂", "1", "'s", "!", "<|endoftext|>", " ", "Z", "\t"]
    texts = ODD + ["".join(rng.choice(parts, int(rng.integers(1, 40)))) for _ in range(400)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    own = bpe(PATH)
    got = [np.frombuffer(x, "<u4") for x in own.encode(texts)]
    assert [x.tolist() for x in got] == want
    assert [own.decode(x.astype(np.int64)).decode() for x in got] == [t.decode(w, skip_special_tokens=False) for w in want]
    assert [np.frombuffer(x, "<u2").tolist() for x in library_encoder(PATH, "<u2")(texts)] == want
    assert own.decode(np.array([t.token_to_id("Ã")])).decode() == t.decode([t.token_to_id("Ã")])


def test_bpe_tables(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (0, ODD[0])]
    out = encoded(table(spark, rows), PATH).collect()
    assert len(out) == len(rows) and all(bytes(r["decoded"]).decode() == (ODD[r["doc_id"]] if r["doc_id"] is not None else "") for r in out)
    assert round_trips(table(spark, rows), PATH).where("round_trip").count() == len(rows)
    assert encoded(table(spark, []), PATH).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    rows = [(i * 3 % 23, t) for i, t in enumerate(ODD)] + [(None, None), (5, ODD[12]), (5, ODD[12])]
    folder = f"file://{tmp_path}/ids"
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_ids(write_ids(table(spark, rows).repartition(3), folder, PATH), folder).collect()))
    ids = {t: tokenizer(PATH).encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}
    assert [g[0] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    assert [g[1] for g in got] == [None, *sorted(i for i, _ in rows if i is not None)]
    assert Counter(g[1:] for g in got) == Counter((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in rows)
    assert read_ids(write_ids(table(spark, []), folder + "2", PATH), folder + "2").count() == 0


def test_shards_by_key(spark):
    rows = [(i, f"text {i % 7}") for i in range(800)] + [(None, None), (None, ""), (5, "again"), (5, "again")]
    got = shards.sharded(table(spark, rows), 7).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 7)
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    few = {r["doc_id"]: r["shard"] for r in shards.sharded(table(spark, rows[:50]), 7).collect()}
    assert all(few[r["doc_id"]] == r["shard"] for r in got if r["doc_id"] in few)
    assert {r["size"] for r in got if r["doc_id"] is None} == {16}
    assert shards.sharded(table(spark, []), 7).count() == 0


def test_maps_move_only_what_they_must():
    for n in range(1, 30):
        old, new = shards.slot_map(n, 512), shards.slot_map(n + 1, 512)
        assert all(a == b or b == n for a, b in zip(old, new))
        sizes = Counter(new).values()
        assert max(sizes) - min(sizes) <= 1
    sizes = [1 + (i * 7919) % 100 for i in range(512)]
    out = shards.rebalanced([0] * 256 + [1] * 128 + [2] * 128, sizes)
    load = Counter()
    for slot, shard in enumerate(out):
        load[shard] += sizes[slot]
    assert max(load.values()) <= sum(load.values()) / 3 * 1.05


LINE = "This is a line that many documents share, over forty characters long."


def drop_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    number = lambda i: -(2**63) if i is None else i
    seen = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                seen.setdefault(k, set()).add(number(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(seen.get(key(x), [])) >= 5 and number(i) != max(seen[key(x)]))]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return Counter(out)


def test_lines_against_brute_force(spark):
    rows = [(i, f"own {i}\n  {LINE.upper() if i % 2 else LINE}\t\n{LINE}\nend" + ("\n" + LINE[:39] if i % 3 else "")) for i in range(9)]
    rows += [(None, None), (None, LINE), (20, ""), (21, "\n\n"), (22, "ü" * 39), (23, "ü" * 40), (8, "other\n" + LINE)]
    docs = table(spark, rows)
    out = without_repeated_lines(docs)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == drop_lines(rows)
    assert [c for c in docs.columns if c not in out.columns] == []
    assert without_repeated_lines(table(spark, [])).count() == 0
    own = ["_id", "_th", "_gone", "gone", "row", "stays", "left", "n_lines"]
    clash = cleaned(docs.select("doc_id", "text", *(F.lit(k).alias(n) for k, n in enumerate(own))))
    assert clash.columns == ["doc_id", "text", *own] and {tuple(r)[2:] for r in clash.collect()} == {tuple(range(len(own)))}


def test_lines_of_repeated_ids_count_once(spark):
    rows = [(1, LINE)] * 4 + [(1, f"{LINE}\nmore"), (2, LINE), (2, LINE), (3, LINE), (None, LINE), (None, LINE), (9, "x" * 300_000 + "\n" + LINE)]
    for n in (len(rows) - 1, len(rows)):  # four documents, then five
        out = without_repeated_lines(table(spark, rows[:n]))
        assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == drop_lines(rows[:n])


def test_leaving_the_joins_out_changes_the_totals(spark, monkeypatch):
    """The runs hold each key once because the merge-join with them says what is new."""
    batches = [line_hashes(table(spark, [(10 * b + i, LINE) for i in range(3)])).cache() for b in range(2)]

    def totals():
        runs = LineRuns(spark)
        for b in batches:
            runs.add(b)
        out = [(r["docs"], r["last"]) for r in runs.totals().collect()]
        runs.forget()
        return out

    assert totals() == [(6, 12)]
    left = type(batches[0]).join
    monkeypatch.setattr(type(batches[0]), "join", lambda self, other, on, how="inner": left(self, other.limit(0) if how == "left" and "there" in other.columns else other, on, how))
    assert totals() != [(6, 12)]


def test_runs_are_joined_without_a_shuffle_of_the_runs(spark):
    runs = LineRuns(spark)
    runs.add(line_hashes(table(spark, [(1, LINE)])))
    own = runs.levels[0][0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = own.join(own.select("h1", "h2", F.lit(1).alias("x")), ["h1", "h2"], "full_outer")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    runs.forget()


def test_runs_are_compacted_and_merge(spark):
    runs = LineRuns(spark, fanout=2)
    fresh = []
    for batch in range(5):
        rows = [(batch * 10 + i, f"{LINE} {i}\n{LINE} {batch}{i}") for i in range(4)]
        fresh.append(runs.add(line_hashes(table(spark, rows))).count())
    assert fresh == [8, 4, 4, 4, 4]
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    totals = runs.totals()
    assert totals.count() == 24 and totals.where("docs = 5").count() == 4 and totals.agg({"last": "max"}).first()[0] == 43
    assert runs.totals(2).count() == 4
    runs.forget()


def test_slot_maps_are_stored_loaded_and_edited(spark, tmp_path):
    store = shards.SlotMap(spark, f"file://{tmp_path}/map")
    sizes = [1 + i * 7919 % 100 for i in range(4096)]
    assert store.create(shards.slot_map(5), sizes) == 1
    again = shards.SlotMap(spark, store.folder)  # another session finds what is stored
    assert again.grow() == 2 and again.rebalance(0.01) == 3
    (_, one, _), (_, two, _), (last, three, held) = store.load(1), store.load(2), store.load()
    assert last == 3 and held == sizes and one == shards.slot_map(5)
    assert all(a == b or b == 5 for a, b in zip(one, two)) and sum(a != b for a, b in zip(one, two)) == 4096 // 6
    load = Counter()
    for shard, size in zip(three, sizes):
        load[shard] += size
    assert max(load.values()) <= sum(sizes) / 6 * 1.01
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store._store(3, one, sizes)


def test_encoder_delay_shortens_the_duration(spark):
    stream = media.wrap(b"payload" * 900)
    audio = stream[media.scan(stream)["offsets"][0] :]
    lame = b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3)
    xing = (media._head(3, False) + b"Xing" + (15).to_bytes(4) + bytes(4 + 4 + 100 + 4) + lame).ljust(media.SIZES[2], b"\0")
    rows = [(1, bytearray(stream)), (2, bytearray(xing + audio)), (3, None)]
    got = {r["doc_id"]: r for r in media.catalog(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert (got[2]["encoder_delay"], got[2]["encoder_padding"]) == (576, 1000) and got[1]["encoder_delay"] == 0
    assert got[2]["duration_us"] == (got[1]["n_samples"] - 1576) * 1_000_000 // 32000
    assert got[1]["seek_offsets"] == media.scan(stream)["offsets"] and all(stream[x] == 255 for x in got[1]["seek_offsets"]) and got[3]["n_frames"] == 0


D = "/root/testdata/sf0.01"


def test_queries_over_the_table_equal_the_library(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    t = tokenizer(PATH)
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in texts.items()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op10_bpe(spark, D).collect()}
    assert got == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids.items()}
    starts, want = 0, {}
    for i in sorted(ids):
        want[i] = (starts, len(ids[i]) + 1, zlib.crc32(np.array([*ids[i], 2], "<u4").tobytes()))
        starts += len(ids[i]) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op9_token_files(spark, D).collect()} == want


def test_token_files_are_read_in_many_tasks(spark, tmp_path):
    rows = [(i, f"text {i} " * 50) for i in range(4000)]
    folder = f"file://{tmp_path}/ids"
    files = write_ids(table(spark, rows), folder, PATH)
    n = files.count()
    out = read_ids(files, folder)
    assert n < 2 or out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert out.count() == 4000


def test_shards_of_the_table(spark):
    rows = shards.op5_shards(spark, D).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    assert len(rows) == len(texts) and sorted(by) == list(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())
