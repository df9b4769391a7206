import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import jpeg, media, registry

PAYLOADS = [bytes(64), bytes([128]) * 64, bytes([128] * 63 + [1]), bytes(range(256)), b"some text, then zeros".ljust(64, b"\0")]


def more_payloads():
    rng = np.random.default_rng(1)
    dense = [rng.integers(0, 256, 64 * k, dtype=np.uint8).tobytes() for k in (1, 5, 7, 40)]
    sparse = [np.where(rng.random(64 * k) < p, 128, rng.integers(100, 160, 64 * k)).astype(np.uint8).tobytes() for k in (1, 7, 40) for p in (0.5, 0.9, 0.99)]
    return PAYLOADS + dense + sparse


def test_payloads_come_back():
    p = more_payloads()
    files = media.encode(p)
    for x, f, (back, rgb) in zip(p, files, media.decode(files), strict=True):
        assert back == x and f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"
        assert rgb.shape[2] == 3 and rgb.dtype == np.uint8
        assert media.encode([x])[0] == f  # neighbours don't matter


def test_samples_follow_the_inverse_transform():
    x = np.random.default_rng(0).integers(100, 156, 384, dtype=np.uint8).tobytes()
    images, coef = jpeg.read_all(media.encode([x]))
    samples = jpeg.samples_of(images, coef)
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = coef[0]
    u = np.arange(8)
    c = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * u[:, None] + 1) * u * np.pi / 16)
    want = np.clip(c @ block.reshape(8, 8) @ c.T + 128, 0, 255)
    assert np.abs(samples[0].reshape(8, 8) - want).max() <= 1
    rgb = jpeg.rgb_tensors(images, coef)[0]
    assert rgb.shape == (16, 16, 3)


def slow_rgb(image, coef):
    """One block and one pixel at a time, in floating point."""
    u = np.arange(8)
    basis = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * u[:, None] + 1) * u * np.pi / 16)
    planes = []
    for c in image.components:
        plane = np.zeros((c.rows * 8, c.cols * 8))
        for i in range(c.rows * c.cols):
            block = np.zeros(64)
            block[jpeg.ZIGZAG] = coef[c.base + i]
            y, x = divmod(i, c.cols)
            plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = np.clip(basis @ block.reshape(8, 8) @ basis.T + 128, 0, 255)
        planes.append((plane, c.h, c.v))
    out = np.zeros((image.height, image.width, 3))
    for y in range(image.height):
        for x in range(image.width):
            ly, cb, cr = (p[y * v // planes[0][2], x * h // planes[0][1]] for p, h, v in planes)
            out[y, x] = np.clip([ly + 1.402 * (cr - 128), ly - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), ly + 1.772 * (cb - 128)], 0, 255)
    return out


def test_rgb_equals_a_slow_conversion():
    rng = np.random.default_rng(4)
    files = media.encode([rng.integers(110, 147, 64 * k, dtype=np.uint8).tobytes() for k in (1, 6, 25)])
    images, coef = jpeg.read_all(files)
    for image, rgb in zip(images, jpeg.rgb_tensors(images, coef), strict=True):
        assert np.abs(slow_rgb(image, coef) - rgb).max() <= 3


class Writer:
    """Bits of one scan; symbols have nine-bit codes."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in reversed(range(n))]

    def symbol(self, s):
        self.put(s, 9)

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        raw = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\x00")


def run_scan(blocks, lo, hi, low, refine):
    """An AC scan of one component without restarts, with end-of-band runs over blocks."""
    w, state = Writer(), {"run": 0, "held": []}

    def flush():
        if state["run"]:
            n = state["run"].bit_length() - 1
            w.symbol(n << 4)
            w.put(state["run"] - (1 << n), n)
            for bit in state["held"]:
                w.put(bit, 1)
            state["run"], state["held"] = 0, []

    for block in blocks:
        size = np.abs(block[lo : hi + 1]) >> low
        new = [k for k in range(len(size)) if (size[k] == 1 if refine else size[k] > 0)]
        zeros, corrections = 0, []
        for k in range(len(size)):
            value = int(block[lo + k])
            if size[k] == 0:
                zeros += 1
                continue
            while zeros > 15 and new and k <= new[-1]:
                flush()
                w.symbol(0xF0)
                for bit in corrections:
                    w.put(bit, 1)
                zeros, corrections = zeros - 16, []
            if refine and size[k] > 1:
                corrections.append(int(size[k] & 1))
                continue
            flush()
            n = 1 if refine else int(size[k]).bit_length()
            w.symbol(zeros << 4 | n)
            w.put(int(value > 0) if refine else int(size[k]) if value > 0 else int(size[k]) ^ ((1 << n) - 1), n)
            for bit in corrections:
                w.put(bit, 1)
            zeros, corrections = 0, []
        if zeros or corrections:
            state["run"] += 1
            state["held"] += corrections
    flush()
    return w.data()


def hand_made(blocks):
    """A grey progressive file: DC, then AC in two bands, first all but the lowest two bits, then these one by one."""

    def marker(code, body):
        return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body

    n = len(blocks)
    spec = bytes([0] * 8 + [255] + [0] * 7) + bytes(range(255))
    out = b"\xff\xd8" + marker(0xC2, bytes([8]) + (8).to_bytes(2, "big") + (8 * n).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])) + marker(0xC4, bytes([0x00]) + spec + bytes([0x10]) + spec)
    w, last = Writer(), 0
    for b in blocks:
        d, last = int(b[0]) - last, int(b[0])
        size = abs(d).bit_length()
        w.symbol(size)
        w.put(d if d >= 0 else d + (1 << size) - 1, size)
    out += marker(0xDA, bytes([1, 1, 0, 0, 0, 0])) + w.data()
    for lo, hi in ((1, 20), (21, 63)):
        for high, low in ((0, 2), (2, 1), (1, 0)):
            out += marker(0xDA, bytes([1, 1, 0, lo, hi, high << 4 | low])) + run_scan(blocks, lo, hi, low, bool(high))
    return out + b"\xff\xd9"


@pytest.mark.parametrize(("n", "share"), [(1, 0.5), (7, 0.0), (40, 0.02), (40, 0.2), (90, 0.6)])
def test_runs_over_blocks(n, share):
    rng = np.random.default_rng(n)
    blocks = np.where(rng.random((n, 64)) < share, rng.integers(-90, 91, (n, 64)), 0)
    blocks[:, 0] = rng.integers(-200, 200, n)
    blocks[n // 3 : n // 2, 1:] = 0
    _, coef = jpeg.read_all([hand_made(blocks), hand_made(blocks[:1])])
    assert (coef[:n] == blocks).all() and (coef[n:] == blocks[:1]).all()


def test_damaged_runs_are_refused():
    w = Writer()
    w.symbol(0xF1)
    w.put(1, 1)
    for _ in range(8):
        w.symbol(0xF1)
        w.put(1, 1)
    good = hand_made(np.zeros((1, 64), int))
    cut = good.index(b"\xff\xda", good.index(b"\xff\xda") + 2)
    bad = good[:cut] + b"\xff\xda\x00\x08" + bytes([1, 1, 0, 1, 63, 0]) + w.data() + b"\xff\xd9"
    with pytest.raises(jpeg.JpegError):
        jpeg.read_all([bad])


def test_other_files_are_refused():
    with pytest.raises(jpeg.JpegError):
        jpeg.parse(b"GIF89a")
    with pytest.raises(jpeg.JpegError):
        jpeg.parse(media.encode([bytes(64)])[0].replace(b"\xff\xc2", b"\xff\xc0"))
    with pytest.raises(jpeg.JpegError):
        jpeg.parse(media.encode([bytes(64)])[0][:-40])


def test_media_columns(spark):
    rows = [(1, "plain"), (2, None), (3, ""), (3, ""), (None, "é" * 3000), (4, "long words " * 20_000), (5, "plain")]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id long, text string").withColumn("rgb", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        raw = text.encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        assert bytes(r.payload) == want and r.n_bytes == len(raw) and len(r.rgb) == 3 * r.height * r.width
        assert by.setdefault(text, (bytes(r.media), bytes(r.rgb))) == (bytes(r.media), bytes(r.rgb))
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    cols, texts = d.columns, {r.doc_id: r.text for r in d.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, sf).toPandas(), d.schema)
        assert d.columns == cols, name
        rows = d.collect()
        assert 0 < len(rows) and {r.doc_id for r in rows} <= set(texts)
        if name == "near_duplicates":
            assert len({r.doc_id for r in rows}) == len(rows)
            kept_words = sum(len(r.text.split()) for r in rows)
        if name == "mixing":
            assert abs(sum(len(r.text.split()) for r in rows) - kept_words) < 0.1 * kept_words
    packed = pipeline.STAGES[-1][1](spark, d, sf).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096
    assert packed[packed["piece"] == 0].shape[0] == d.count()
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", None, 0), (1, "", "en", None, 0), (2, None, None, "s", None), (3, "a b c\n" * 40, "en", "s", 240), (3, "a b c\n" * 40, "en", "s", 240)]])
def test_pipeline_stages_take_odd_rows(spark, tmp_path, rows):
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ("_id", "_digest", "_doc", "_runs", "runs", "n_lines", "_copy", "size", "taken", "_d", "_lines", "label", "cls")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.createDataFrame(rows, schema).selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(clash)])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        got = out.collect()
        assert all(r[c] == i for r in got for i, c in enumerate(clash)), name
        d = spark.createDataFrame(got, out.schema)
    packed = pipeline.STAGES[-1][1](spark, d, str(tmp_path))
    assert packed.where("piece = 0").count() == d.count()


def test_registry_is_complete():
    numbers = sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES)
    assert numbers == list(range(1, 11)) and set(registry.SQL) <= set(registry.QUERIES)


def test_secret_digest(spark):
    got = registry.QUERIES["op10_trigram_secrets"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in got if not any(k in r.spans for k in ("code_host", "chat", "web", "maps", "payment", "private")))


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    from test_text_operators import brute_components, brute_lines

    import corpus_pipeline as pipeline
    from tallyforge.llm.linededup import MIN_WORDS

    rng = np.random.default_rng(5)

    def prose(n):
        return [f"w{x}" for x in rng.integers(0, 3000, n)]

    passage = "\n".join(" ".join(prose(12)) for _ in range(6))
    toxic, rows = set(), []
    for i in range(500):
        lines = [" ".join(prose(20)) for _ in range(4)]
        if i % 5 == 0:
            toxic.add(i)
            lines[i % 4] += " foulword nastyterm vileterm"
        elif i % 7 == 1:
            lines[2:2] = passage.split("\n")
        rows.append((i, "\n".join(lines)))
    clean = [r for r in rows if r[0] not in toxic]
    rows += [(1000 + k, clean[k][1].replace("\n", " ", 1) + f" x{k}") for k in range(40)]  # near copies
    rows += [(2000 + k, passage) for k in range(3)] + [(3000, None), (3001, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    d = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], schema)
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(pipeline.STAGES)

    def after(name, docs):
        out = spark.createDataFrame(stages[name](spark, docs, str(tmp_path)).collect(), schema)
        return out, [(r.doc_id, r.text) for r in out.collect()]

    d, got = after("toxicity", d)
    want = [r for r in rows if r[0] not in toxic]
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    cut = brute_lines([r for r in want if r[1] is not None], MIN_WORDS) | {3000: None}
    want = [(i, cut[i]) for i, t in want if cut[i] == t or (cut[i] or "").split()]
    assert 0 < sum(cut[i] != t for i, t in got) and len(want) < len(got)
    d, got = after("line_dedup", d)
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert all(r.n_chars == len(r.text or "") for r in d.collect())
    first = {c for _, n, c in brute_components(want) if n}
    want = [(i, t) for i, t in want if i in first or not (t or "").split()]
    assert len(want) < len(got)
    d, got = after("near_duplicates", d)
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    d, got = after("mixing", d)
    assert set(got) <= set(want)
    packed = stages["packing"](spark, d, str(tmp_path)).toPandas()
    assert sorted(packed[packed["piece"] == 0]["doc_id"]) == sorted(i for i, _ in got)
