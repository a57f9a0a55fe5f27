import hashlib
import struct
import zlib

from attestra.llm import media


def test_png_round_trip_and_padding():
    for n in (0, 1, 575, 576, 577, 5000):
        p = media.padded(bytes(range(256)) * (n // 256) + b"x" * (n % 256))
        assert len(p) % 576 == 0 and len(p) > 0
        assert media.from_png(media.to_png(p)).tobytes() == p


def test_sequence_keeps_order_and_captions():
    html = '<p>One <b>two</b></p><figure><img src="media:aa"><figcaption>Cap <i>x</i></figcaption></figure>three<img src="http://x/y.png" alt="Alt"><script>no</script><img>'
    got = [(e["position"], e["kind"], e["text"], e["digest"], e["caption"]) for e in media.sequence_of(html)]
    assert got == [(0, "text", "One two", None, None), (1, "img", None, "aa", "Cap x"), (2, "text", "three", None, None), (3, "img", "http://x/y.png", None, "Alt")]
    assert media.sequence_of(None) == [] == media.sequence_of("")


def test_documents(spark):
    texts = {1: None, 2: "", 3: "né" * 400, 4: "né" * 400, 5: "z" * 576, None: "q" * 100_000}
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, feature string")
    rows = {r["doc_id"]: r for r in media.media_features(docs).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        data = (t or "").encode()
        p = media.padded(data)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(p), hashlib.sha256(p).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(p[-32:]) and r["media_sha256"] == hashlib.sha256(media.to_png(p)).hexdigest()
    assert rows[3]["feature"] == rows[4]["feature"] and rows[1]["media_sha256"] == rows[2]["media_sha256"]
    assert media.media_features(docs.where("false")).count() == 0


def test_unknown_digests_resolve_to_null(spark):
    pages = spark.createDataFrame([(1, '<img src="media:none">'), (2, None)], "page_id long, html string")
    seqs = media.sequences(pages, "page_id", "html")
    got = media.resolve(seqs, "page_id", spark.createDataFrame([], media.FEATURES)).collect()
    assert len(got) == 1 and got[0]["media_bytes"] is None and got[0]["page_id"] == 1


def png_samples(data):
    """Lines of an 8-bit grey PNG, by a reader that knows all line filters."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, packed = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height, depth, colour, compression, filters, interlace = struct.unpack(">IIBBBBB", body)
            assert (depth, colour, compression, filters, interlace) == (8, 0, 0, 0, 0)
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    assert kind == b"IEND"
    raw, lines, above = zlib.decompress(packed), [], [0] * width
    for y in range(height):
        how, line = raw[y * (width + 1)], list(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            a, b, c = (line[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[x] = (line[x] + [0, a, b, (a + b) // 2, paeth][how]) % 256
        lines.append(line)
        above = line
    return lines


def plain_feature(lines):
    width, height = len(lines[0]), len(lines)
    columns = [sum(line[x] for line in lines) for x in range(width)]
    cells = [sum(columns[9 * k : 9 * k + 9]) for k in range(64)]
    bits = sum((cells[k] < cells[(k + 1) % 64]) << (63 - k) for k in range(64))
    return f"{width}x{height}:{sum(columns) * 1000 // (width * height)}:{bits:016x}"


def test_driver_table_against_another_reader(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 3000")
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.store_texts(docs).select("doc_id", "media").collect()}
    rows = {r["doc_id"]: r for r in media.media_features(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(rows) == set(texts) and len(rows) > 50
    for i, t in texts.items():
        lines, r = png_samples(stored[i]), rows[i]
        payload = b"".join(map(bytes, lines))
        data = t.encode()
        assert payload.startswith(data) and set(payload[len(data) :]) <= {255} and len(payload) % 576 == 0 and 0 <= len(payload) - len(data) < 576 + (not data)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest(), plain_feature(lines))
