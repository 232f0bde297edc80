"""What surrounds learned models, with weights made up here: the head, sessions, installation, joins; pictures and frame streams."""

import hashlib
import io
import struct
import zipfile

import numpy as np
import pytest
from test_engine import scene

from tessella.functions import descriptor_head
from tessella.operators import frames, matching
from tessella.sources import models, pictures
from tessella.streaming import selection


def weights(c=4, p=3, k=3, d=5, seed=1):
    rng = np.random.default_rng(seed)
    shapes = ((2 * p, c * k * k), (2 * p,), (2 * p, 2 * p), (2 * p,), (c, c), (p * c, d))
    return b"ALKH" + struct.pack("<4i", c, p, k, d) + b"".join((rng.normal(size=s) * 0.7).astype("<f4").tobytes() for s in shapes)


def test_head_equals_one_pixel_at_a_time():
    head = descriptor_head.read_head(weights())
    rng = np.random.default_rng(2)
    width, height = 20, 14
    levels = [rng.normal(size=(2, 14, 20)), rng.normal(size=(1, 7, 10)), rng.normal(size=(1, 3, 4))]
    points = np.array([[3.4, 5.9], [0, 0], [19, 13], [12.2, 7.7], [np.nan, 4], [40, -3]])
    got = descriptor_head.described(head, levels, width, height, points)

    def pixel(x, y):
        out = []
        for level in levels:
            _, h, w = level.shape
            u, v = x * (w - 1) / (width - 1), y * (h - 1) / (height - 1)
            i, j = int(u), int(v)
            for channel in level:
                value = lambda a, b: channel[min(b, h - 1), min(a, w - 1)]  # noqa: E731, B023
                top = value(i, j) * (1 - u + i) + value(i + 1, j) * (u - i)
                low = value(i, j + 1) * (1 - u + i) + value(i + 1, j + 1) * (u - i)
                out.append(top * (1 - v + j) + low * (v - j))
        return np.array(out) / np.linalg.norm(out)

    for row, (x, y) in zip(got, np.clip(np.nan_to_num(points, nan=0.0), 0, [19, 13]), strict=True):
        x0, y0 = (int(np.clip(int(int(a) - 1.5 + 1), 0, size - 4)) for a, size in ((x, width), (y, height)))
        patch = np.array([[[pixel(x0 + i, y0 + j)[ch] for i in range(3)] for j in range(3)] for ch in range(4)]).ravel()
        offsets = np.clip(descriptor_head.selu(head.offsets @ patch + head.offsets_bias) @ head.second.T + head.second_bias, -5, 5)
        samples = []
        for n in range(3):
            u, v = x + offsets[n], y + offsets[3 + n]
            total = np.zeros(4)
            for i in (int(np.floor(u)), int(np.floor(u)) + 1):
                for j in (int(np.floor(v)), int(np.floor(v)) + 1):
                    if 0 <= i < width and 0 <= j < height:
                        total += (1 - abs(u - i)) * (1 - abs(v - j)) * pixel(i, j)
            samples.append(descriptor_head.selu(head.samples @ total))
        want = np.concatenate(samples) @ head.aggregation
        assert np.allclose(row, want / max(np.linalg.norm(want), 1e-12), atol=1e-6)
    assert descriptor_head.described(head, levels, width, height, np.zeros((0, 2))).shape == (0, 5)


def test_files_that_are_no_head_are_refused():
    good = weights()
    for bad in (b"", b"ALKX" + good[4:], good[:-4], good + b"1234", b"ALKH" + struct.pack("<4i", 4, 3, 2, 5) + good[20:], b"ALKH" + struct.pack("<4i", 0, 3, 3, 5)):
        with pytest.raises(ValueError):
            descriptor_head.read_head(bad)
    with pytest.raises(ValueError):
        descriptor_head.described(descriptor_head.read_head(good), [np.zeros((3, 9, 9))], 9, 9, np.zeros((1, 2)))


def archive(files):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as out:
        for name, content in files.items():
            out.writestr(name, content)
    return sink.getvalue()


FILES = {"Models/extractor.onnx": b"e", "Models/descriptor_head.bin": b"h", "Models/../../matcher.onnx": b"m"}


def test_models_are_installed_whole_or_not_at_all(tmp_path):
    data, place = archive(FILES), tmp_path / "Models"
    digest = hashlib.sha256(data).hexdigest()
    with pytest.raises(ValueError):
        models.install([data], "0" * 64, place)
    partly = archive({k: v for k, v in FILES.items() if "head" not in k})
    with pytest.raises(ValueError):
        models.install([partly], hashlib.sha256(partly).hexdigest(), place)
    assert not place.exists() and not list(tmp_path.iterdir())
    heard = []
    assert models.install([data[:50], data[50:]], digest, place, lambda *a: heard.append(a)) == place
    assert models.capabilities(place) == {"extractor", "matcher"} and heard[-1] == ("extracting", len(data))
    (place / "old").write_text("x")
    models.install([data], digest.upper(), place)
    assert not (place / "old").exists() and [p.name for p in tmp_path.iterdir()] == ["Models"]
    (place / "matcher.onnx").write_bytes(b"")
    assert models.capabilities(place) == {"extractor"}
    assert models.first_usable([tmp_path / "none", place], ["extractor"]) == place and models.first_usable([place]) is None
    assert models.search_paths("/given", tmp_path)[:2] == [models.Path("/given"), tmp_path.resolve() / "Models"]
    work = tmp_path / ".Models-left"
    work.mkdir()
    models.remove_abandoned(place)
    assert work.exists()
    models.remove_abandoned(place, now=work.stat().st_mtime + 2 * models.ABANDONED_AFTER)
    assert not work.exists()


def identity_model(shape):
    """A model that gives back its input, encoded by hand."""

    def number(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    field = lambda i, data: number(i << 3 | 2) + number(len(data)) + data
    value = lambda i, n: number(i << 3) + number(n)
    dims = b"".join(field(1, value(1, n) if n else field(2, b"n")) for n in shape)
    info = lambda name: field(1, name) + field(2, field(1, value(1, 1) + field(2, dims)))
    node = field(1, b"x") + field(2, b"y") + field(4, b"Identity")
    graph = field(1, node) + field(2, b"g") + field(11, info(b"x")) + field(12, info(b"y"))
    return value(1, 8) + field(7, graph) + field(8, field(1, b"") + value(2, 13))


def test_sessions_are_checked():
    pytest.importorskip("onnxruntime")
    model = identity_model([0, 4])
    made = models.session(model, {"x": (None, 4)}, {"y": (None, 4)})
    x = np.arange(8, dtype=np.float32).reshape(2, 4)
    assert np.array_equal(made.run(["y"], {"x": x})[0], x)
    for inputs, outputs in (({"x": (None, 5)}, {}), ({"z": (None, 4)}, {}), ({}, {"y": (None, 4, 1)})):
        with pytest.raises(ValueError):
            models.session(model, inputs, outputs)


def test_learned_matches_are_joined(spark):
    rows = [(image, 10 * i, float(i), 2.0 * i, [float(i), float(image)]) for image, n in ((0, 4), (1, 3), (2, 2)) for i in range(n)]
    points = spark.createDataFrame(rows, "image long, idx long, x double, y double, vec array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 1)], "a long, b long")

    def load():
        def matcher(pa_, va, pb, vb):
            assert pa_.shape[1] == 2 and va.shape[1] == vb.shape[1] == 2
            d = np.abs(va[:, None, 0] - vb[None, :, 0])
            return np.where(d.min(axis=1) == 0, d.argmin(axis=1), -1), 1 / (1 + pa_[:, 0])

        return matcher

    got = matching.learned_join(points, pairs, load, 0.3).collect()
    assert sorted((r["a"], r["b"], r["ia"], r["ib"]) for r in got) == [(0, 1, 0, 0), (0, 1, 10, 10), (0, 1, 20, 20), (0, 2, 0, 0), (0, 2, 10, 10)]


def test_pair_pictures_show_photos_matches_and_verdict():
    a, b = scene(200, 150), scene(100, 160)
    matches = np.array([[10, 10, 20, 20], [100, 80, 50, 100], [150, 20, 5, 150.0]])
    out = pictures.pair_picture(a, b, matches, np.array([True, False, True]), "verified", 400)
    assert out.shape == (160 + pictures.BAND, 200 + pictures.GAP + 100, 3) and tuple(out[0, 0]) == pictures.GOOD
    plain = pictures.pair_picture(a, b, matches[:0], np.zeros(0, bool), "noConsistentModel", 400)
    assert tuple(plain[0, 0]) == pictures.BAD and np.array_equal(plain[pictures.BAND : pictures.BAND + 150, :200], a)
    changed = (out[pictures.BAND :] != plain[pictures.BAND :]).any(axis=2)
    assert changed[10, 10] and changed[20, 200 + pictures.GAP + 20] and 300 < changed.sum() < 1500
    hidden = pictures.pair_picture(a, b, matches, np.array([True, False, True]), "verified", 400, show_outliers=False)
    assert not np.array_equal(hidden, out)


def test_frames_on_a_stream_are_measured_as_in_a_table(spark, tmp_path):
    whole = scene(400, 160)[..., 0]
    at = [0, 12, 25, 37, 48, 60]
    rows = [(v, i, 120, 160, whole[20:140, x + 5 * v : x + 5 * v + 160].tobytes(), False) for v in (0, 1) for i, x in enumerate(at)]
    schema = "video long, idx long, height int, width int, pixels binary, ended boolean"
    table = frames.measure_frames(spark.createDataFrame(rows, schema)).collect()
    want, x = {}, {}
    for r in sorted(table, key=lambda r: (r["video"], r["idx"])):
        x[r["video"]] = x.get(r["video"], 0.0) + r["dx"]
        want[r["video"], r["idx"]] = x[r["video"]]
    batches = [[r for r in rows if r[1] < 3], [r for r in rows if r[1] in (2, 3, 4)], [r for r in rows if r[1] == 5] + [(0, 99, 0, 0, b"", True)]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 0:
            stream = selection.measure_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["video"], r["idx"]) for r in got if not r["ended"]) == sorted(want) and sum(r["ended"] for r in got) == 1
    for r in got:
        if not r["ended"]:
            assert r["px"] == pytest.approx(want[r["video"], r["idx"]], abs=1e-9)
    assert abs(want[0, 5]) == pytest.approx(60 / 160, abs=0.02)
