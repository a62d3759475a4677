"""The live source: recordings that grow, read with restarts between, give each chunk once."""

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException

from strandline.sources.blocks import PcmBlocks
from strandline.streaming import chunks as C

SF = "/root/testdata/sf0.001"


def recorded(spark):
    """Blocks of embeddings as sessions: (session, samples) in the order of vec_id."""
    out = {}
    for x in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect():
        out.setdefault(x.label, []).append(np.array(x.embedding, "<f4"))
    return out


def append(folder, session, data):
    with open(f"{folder}/{session}.f32", "ab") as f:
        f.write(data)


def plain_chunks(blocks, n=6, window=20):
    """Chunks of n blocks and the windows that end with them."""
    out, all_ = [], np.concatenate(blocks)
    size = len(blocks[0])
    for i in range(len(blocks) // n):
        end = (i + 1) * n * size
        padded = np.concatenate([np.zeros(window * size, "<f4"), all_[:end]])[-window * size :]
        out.append((i, n, i * n, tuple(all_[end - n * size : end].tolist()), tuple(padded.tolist())))
    return out


def test_recordings_to_chunks(spark, tmp_path, monkeypatch):
    said = recorded(spark)
    size = len(next(iter(said.values()))[0])
    folder = tmp_path / "pcm"
    folder.mkdir()
    (folder / "notes.txt").write_text("not a session")
    spark.dataSource.register(PcmBlocks)

    def go(fail=None):
        stream = spark.readStream.format("pcm_blocks").option("path", str(folder)).option("block", size).load()
        made = C.chunk_stream(stream, 6 * size, 20 * size)
        if fail:
            made = made.selectExpr("session", f"if(raise_error('{fail}') IS NULL, chunk_idx, 0) AS chunk_idx", "n_blocks", "first_block", "samples", "window")
        q = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
        q.trigger(availableNow=True).start().awaitTermination()

    half = {s: b[: 4 + 3 * i] for i, (s, b) in enumerate(sorted(said.items()))}
    for s, b in half.items():
        append(folder, s, np.concatenate(b).tobytes() + b"\1\2\3")  # a recorder in the middle of a block
    go()
    for s, b in said.items():
        rest = np.concatenate(b[len(half[s]) :]).tobytes() if len(b) > len(half[s]) else b""
        with open(folder / f"{s}.f32", "r+b") as f:
            f.truncate(len(half[s]) * size * 4)
        append(folder, s, rest)
    with pytest.raises(StreamingQueryException):
        go("killed")
    go()
    go()  # nothing new
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = sorted((s, *c) for s, b in said.items() for c in plain_chunks(b))
    assert sorted((x.session, x.chunk_idx, x.n_blocks, x.first_block, tuple(x.samples), tuple(x.window)) for x in got) == want and len(want) > 20
    # The same as a batch, from the same source, and by the fold.
    batch = spark.read.format("pcm_blocks").option("path", str(folder)).option("block", size).load()
    got = C.chunks(batch, 6 * size, 20 * size).collect()
    assert sorted((x.session, x.chunk_idx, x.n_blocks, x.first_block, tuple(x.samples), tuple(x.window)) for x in got) == want
    assert batch.where("session = 3").selectExpr("min(block_idx)", "max(at)").first()[0] == 0


def test_excess_is_dropped():
    c = C.Chunker(10, 15)
    out = [c.add(i, [float(i)] * 4) for i in range(7)]
    made = [o for o in out if o]
    assert [m[:3] for m in made] == [(0, 3, 0), (1, 3, 3)]
    assert made[0][3] == [0.0] * 4 + [1.0] * 4 + [2.0] * 2 and made[0][4] == [0.0] * 5 + made[0][3]
    assert made[1][4] == made[0][3][-5:] + made[1][3]
    assert c.add(3, [9.0] * 20) is None and c.add(7, None) is None and c.state()[3] == 2


def test_channels_and_empty_folders(spark, tmp_path):
    spark.dataSource.register(PcmBlocks)
    read = lambda path: spark.read.format("pcm_blocks").option("path", path).option("block", 3).option("channels", 2).load()
    assert read(f"{tmp_path}/none").count() == 0
    folder = tmp_path / "two"
    folder.mkdir()
    append(folder, -5, np.arange(14, dtype="<f4").tobytes())
    assert [(x.session, x.block_idx, x.samples) for x in read(str(folder)).collect()] == [(-5, 0, [0.0, 2.0, 4.0]), (-5, 1, [6.0, 8.0, 10.0])]
