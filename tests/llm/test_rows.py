"""Operators that take a row at a time, against the obvious program."""

import hashlib
import random
import re
import unicodedata
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.llm import bpe, license_scan, mpeg_audio, sharding, warc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


NOTICE = " ".join(license_scan.NOTICES["mit"].replace("[", "").replace("]", "").split())


def test_licence_places(spark, docs, rows):
    more = [(20, NOTICE.upper(), *rows[0][2:]), (21, f"(C) us. {NOTICE[:300]} and so on", *rows[0][2:]), (22, "gnu lesser general public license as published by", *rows[0][2:]),
            (23, "some files of which the Mozilla Public License is one are subject to the terms of the Mozilla Public License, v. 2.0. If", *rows[0][2:])]
    got = sorted(map(tuple, license_scan.scan(docs.unionByName(spark.createDataFrame(more, docs.schema))).collect()), key=str)
    want = []
    for i, text, *_ in rows + more:
        w = WORD.findall(lower(text))
        base, own, names, score = [], set(), set(), 0.0
        for label, is_base, phrases, notice in license_scan.TEMPLATES:
            first = phrases[0][0]
            at = [p - first for p in range(len(w)) if all(w[p - first + o : p - first + o + len(x)] == x for o, x in phrases)]
            if at and is_base:
                base += at
                names.add(label)
                score = max(score, license_scan.PHRASE_SCORE)
            elif at:
                own.add(label)
                known = [(k, x) for k, x in enumerate(notice) if x]
                score = max([score, *(sum(0 <= p + k < len(w) and w[p + k] == x for k, x in known) / len(known) for p in at)])
        want.append((i, len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(names)), ",".join(sorted(names | own)), score))
    assert got == sorted(want, key=str)
    scores = {r[0]: r[-1] for r in got}
    assert scores[20] == 1.0 and 0.3 < scores[21] < 0.8 and scores[22] == 0.5 and scores[4] == 0.0


def test_licence_notices_have_key_phrases():
    for label, _, phrases, notice in license_scan.TEMPLATES:
        assert phrases and all(notice[o : o + len(x)] == x for o, x in phrases), label


def test_licence_empty(nothing):
    assert license_scan.scan(nothing).count() == 0


def test_sharding_is_rendezvous(docs, rows, nothing):
    got = sharding.shard_documents(docs, chunks=8).collect()
    assert len(got) == len(rows)

    def place(i, n):
        key = "null" if i is None else str(i)
        unit = [(int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for s in range(n)]
        return max(range(n), key=lambda s: (unit[s], -s))

    sizes = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sizes
    slots = {}
    for r in got:
        assert r.shard == place(r.doc_id, 40)
        assert r.grown_shard in (r.shard, 40) and r.grown_shard == place(r.doc_id, 41)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(nothing).count() == 0


def test_weights_draw_rows(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    got = {r.shard: r["count"] for r in sharding.shard_documents(docs, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 0.7 < got[1] / 4000 < 0.8


def test_media_round_trip(docs, rows, nothing):
    got = {(r.doc_id, r.payload_sha256): r for r in mpeg_audio.media_features(docs).collect()}
    for i, text, *_ in rows:
        data = mpeg_audio.pad((text or "").encode())
        r = got[i, hashlib.sha256(data).hexdigest()]
        assert (r.payload_bytes, r.tail_crc32, r.bad_crc, r.resync_bytes) == (len(data), zlib.crc32(data[-64:]), 0, 0)
        assert len(data) % 64 == 0 and r.duration_us == r.n_frames * 24_000 and len(r.seek_offsets) == r.n_frames
        assert r.media_sha256 == hashlib.sha256(mpeg_audio.encode(data)).hexdigest()
    assert mpeg_audio.media_features(nothing).count() == 0
    assert mpeg_audio.store_media(docs).count() == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=4000))
def test_media_any_bytes(data):
    payload = mpeg_audio.pad(data)
    assert mpeg_audio.payload_of(mpeg_audio.parse(mpeg_audio.encode(payload))) == payload


def test_media_resync_and_crc():
    media = mpeg_audio.encode(mpeg_audio.pad(b"q" * 3000))
    clean = mpeg_audio.parse(media)
    at = clean["offsets"][1]
    torn = mpeg_audio.parse(media[:at] + b"\xff\x00junk" + media[at:])
    assert torn["resync_bytes"] == 6 and len(torn["offsets"]) == len(clean["offsets"])
    flipped = bytearray(media)
    flipped[at + 8] ^= 1
    assert mpeg_audio.parse(bytes(flipped))["bad_crc"] == 1
    assert clean["table"][0] == len(clean["offsets"]) and clean["table"][1] == len(media) - (clean["offsets"][0] - 192)
    assert mpeg_audio.parse(b"")["offsets"] == [] and mpeg_audio.parse(b"\xff" * 500)["offsets"] == []


def _stream(version, layer, bitrate, rate, mode, frames, guarded=True):
    """A foreign stream of silent frames of Layer I or III, its CRCs right."""
    out = b""
    for k in range(frames):
        head = bytes([0xFF, 0xE0 | version << 3 | layer << 1 | (not guarded), bitrate << 4 | rate << 2 | (k % 2) << 1, mode << 6])
        h = mpeg_audio.Header(head, 0)
        n = h.protected()
        crc = mpeg_audio.crc16(head[2:] + bytes(n)).to_bytes(2, "big") if guarded else b""
        out += (head + crc).ljust(h.size, b"\0")
    return out


def test_foreign_streams_have_exact_durations():
    # 44.1 kHz stereo Layer III: 1152 samples a frame do not divide into microseconds
    stream = _stream(3, 1, 9, 0, 0, 9)
    assert len(stream) == 5 * 417 + 4 * 418
    got = mpeg_audio.parse(stream)
    assert (got["samples"], got["bad_crc"], got["resync_bytes"], got["unverified"]) == (9 * 1152, 0, 0, 0)
    assert got["seconds"] == Fraction(9 * 1152, 44_100) and got["duration_us"] == 9 * 1152 * 1_000_000 // 44_100 != 9 * (1152 * 1_000_000 // 44_100)
    # MPEG-2 Layer III at 22.05 kHz has half the samples, Layer I 384; streams of two rates add up
    low, first = _stream(2, 1, 8, 0, 3, 6), _stream(3, 3, 5, 2, 1, 4)
    both = mpeg_audio.parse(low + first)
    assert both["seconds"] == Fraction(6 * 576, 22_050) + Fraction(4 * 384, 32_000) and both["bad_crc"] == both["resync_bytes"] == 0
    assert both["offsets"][6] == len(low)
    second = mpeg_audio.parse(_stream(3, 2, 8, 1, 0, 3))
    assert (second["samples"], second["unverified"]) == (3 * 1152, 3)


def test_tags_of_all_versions_are_read():
    def synchsafe(n):
        return bytes(n >> s & 127 for s in (21, 14, 7, 0))

    stream = _stream(3, 1, 9, 0, 0, 3)
    frames = b"TIT2" + (7).to_bytes(4, "big") + b"\0\0" + "\3Änd!".encode() + b"\0" + b"APIC" + (3).to_bytes(4, "big") + b"\0\0abc"
    frames += b"TXXX" + (13).to_bytes(4, "big") + b"\0\0\0payload\x001234"
    v23 = b"ID3\x03\0\0" + synchsafe(len(frames) + 20) + frames + bytes(20)
    frames = b"TPE1" + synchsafe(8) + b"\0\0\x01" + "abc".encode("utf-16")[:7]
    v24 = b"ID3\x04\0\0" + synchsafe(len(frames)) + frames
    v1 = b"TAG" + b"one".ljust(30, b"\0") + b"two".ljust(30, b" ") + bytes(30) + b"1999" + bytes(31)
    got = mpeg_audio.parse(v23 + v24 + stream + v1)
    assert got["tags"]["TIT2"].startswith("Änd") and got["declared"] == 1234 and got["tags"]["artist"] == "two" and got["tags"]["year"] == "1999"
    assert got["resync_bytes"] == 0 and got["offsets"][0] == len(v23 + v24) and len(got["offsets"]) == 3
    assert mpeg_audio.parse(v23[:14])["offsets"] == []


def test_vbri_table_is_read():
    stream = bytearray(_stream(3, 1, 9, 0, 0, 4))
    table = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (5000).to_bytes(4, "big") + (3).to_bytes(4, "big")
    table += (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + b"\0\7\0\x08"
    crc = mpeg_audio.crc16(bytes(stream[2:4]) + bytes(30) + table[:2])
    stream[36 : 36 + len(table)] = table
    stream[4:6] = crc.to_bytes(2, "big")
    got = mpeg_audio.parse(bytes(stream))
    assert got["table"] == (3, 5000, b"\0\7\0\x08") and len(got["offsets"]) == 3 and got["bad_crc"] == 0


def test_crc16_known():
    assert mpeg_audio.crc16(b"") == 0xFFFF and mpeg_audio.crc16(b"123456789") == 0xAEE7


def test_bpe_equals_the_library(docs, rows, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    want = []
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))]
        want.append((i, len(ids), *sha))
    assert sorted(map(tuple, bpe.encode_digests(docs, bpe.default_path()).collect()), key=str) == sorted(want, key=str)
    assert bpe.encode_digests(nothing, bpe.default_path()).count() == 0
    full = bpe.encode_documents(docs, bpe.default_path()).collect()
    assert all(t.decode(r.ids, skip_special_tokens=False) == r.decoded for r in full)


def test_bpe_equals_the_library_on_every_code_point():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    codec = bpe.Codec(bpe.vocabulary(bpe.default_path()))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 64):
        text = " ".join(f"b{c}b !{c}! {c}1{c}" for c in points[at : at + 64])
        mine = [p.encode().decode("latin-1").translate(codec.table) for c in codec.segments(text) for p in codec.pieces.findall(c)]
        assert mine == [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))], hex(ord(points[at]))


def test_bpe_equals_the_library_on_marked_letters():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    codec = bpe.Codec(bpe.vocabulary(bpe.default_path()))
    rng = random.Random(12)
    marks = [c for c in map(chr, range(0x11000)) if unicodedata.combining(c)]
    pools = [range(0x20, 0x250), range(0x300, 0x370), range(0x370, 0x600), range(0x900, 0xE00), range(0x1100, 0x1200), range(0x1E00, 0x2100), range(0xAC00, 0xAC80), range(0x1F600, 0x1F640)]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(1, 30))) for _ in range(5_000)]
    texts += [rng.choice("aeq가") + "".join(rng.choices(marks, k=3)) for _ in range(5_000)]
    mine = [[int(i) for i in ids.split()] for _, ids in codec.encode_batch(texts)]
    theirs = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [x for x, m, o in zip(texts, mine, theirs, strict=True) if m != o] == []


def test_pipeline_decodes_the_ids(spark, docs, rows, monkeypatch):
    import corpus_pipeline
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").select("doc_id", "n_tokens", "ids", "decoded").collect()
    assert len(got) == len(rows)
    assert all(r.decoded == t.decode(r.ids, skip_special_tokens=False) and r.n_tokens == len(r.ids) for r in got)
    # digests too are of what the ids decode to
    monkeypatch.setattr(bpe.Codec, "decode", lambda self, ids: str(len(ids)))
    for r in bpe.encode_digests(docs, bpe.default_path()).collect():
        assert r.decoded_sha256 == hashlib.sha256(str(r.n_tokens).encode()).hexdigest()


def test_bpe_verification_equals_merging():
    codec = bpe.Codec(bpe.vocabulary(bpe.default_path()))
    words = ["hello", "anderwhtionwh", "onnthlyer", "x", "qqqqqq", "unbelievably", "réêou".encode().decode("latin-1")]
    codec.learn(words)
    for w in words:
        spelled = w.encode().decode("latin-1").translate(codec.table)
        assert codec.words[w][1] == " ".join(map(str, codec.exact(spelled)))


def test_warc_links_and_digests(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/", "<html><head><title> A  b </title><script>x<p></script></head><body><p>One &amp; two<br>three</p><!-- no --><a class='k' href=\"/z\">link</a></body></html>"),
         (2, None, None), (3, "http://c/", ""), (3, "http://c/", "")],
        "page_id long, url string, html string",
    )
    out = warc.derive(warc.responses(pages)).collect()
    assert len(out) == 8
    meta, text = (next(r for r in out if r.page_id == 1 and r.warc_type == k) for k in ("metadata", "conversion"))
    assert text.block == "A b\nOne & two\nthree\nlink"
    assert meta.refers_to == text.refers_to and meta.record_id != text.record_id
    assert "outlink: /z L a/@href" in meta.block and "title: A b" in meta.block and "http-status: 200" in meta.block
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest()
    assert text.content_length == len(text.block.encode())
    assert "Content-Type: text/html" in text.source_headers
    assert {r.block for r in out if r.page_id == 2 and r.warc_type == "conversion"} == {""}
    rendered = warc.render(warc.derive(warc.responses(pages))).collect()
    assert all(r.warc.startswith("WARC/1.1\r\nWARC-Type: ") for r in rendered)
    one = next(r.warc for r in rendered if r.record_id == text.record_id)
    assert f"WARC-Payload-Digest: {text.payload_digest}\r\n" in one and "WARC-Source-Header: Content-Type: text/html" in one
    assert "WARC-Refers-To-Target-URI: http://a/\r\n" in one and f"WARC-Refers-To-Date: {text.warc_date}\r\n" in one
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_clashing_columns_and_long_pages(spark):
    page = "<p>" + "<b>word</b> <br>" * 40_000 + "</p>"
    pages = spark.createDataFrame([(2**60 + 1, "http://l/", page, "x", "y", "z"), (None, "http://n/", "<title>n</title>", None, None, None)],
                                  "page_id long, url string, html string, block string, message string, payload string")
    out = {(r.page_id, r.warc_type): r for r in warc.derive(warc.responses(pages)).collect()}
    assert len(out) == 4 and out[2**60 + 1, "conversion"].block.count("word") == 40_000
    assert "title: n" in out[None, "metadata"].block
