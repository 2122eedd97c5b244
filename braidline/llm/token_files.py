"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in descending corpus frequency, so that most take one
byte. A block holds up to a million values: documents' ids and lengths, then control
bytes (two bits a value: its bytes less one) apart from the data bytes. Decoding looks
each control byte up in a table of byte masks and fills four values at once.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialise
from .tokens import chunks, encoder

MAGIC = b"BLTOK1\n\0"
HEAD = "<IIQQQ"
BLOCK_VALUES = 1_000_000


def open_store(url: str):
    """File system and path of a URL in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


def pack(values):
    """Control bytes and data bytes of unsigned 32-bit values."""
    import numpy as np

    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype("u1") + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-len(v) % 4 + len(v), "u1")
    codes[: len(v)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = v.view("u1").reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype("u1").tobytes(), data.tobytes()


def _masks():
    import numpy as np

    codes = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
    return (np.arange(4) <= codes[:, :, None]).reshape(256, 16)


def unpack(control: bytes, data: bytes, n: int):
    """The ``n`` values of a block."""
    import numpy as np

    mask = _masks()[np.frombuffer(control, "u1")]
    if n % 4:
        mask[-1, 4 * (n % 4) :] = False
    out = np.zeros(mask.shape, "u1")
    out[mask] = np.frombuffer(data, "u1")
    return out.reshape(-1).view("<u4")[:n]


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_tokens and ids with the end id (two bytes an id where the vocabulary
    allows, as its ids cross the network once); and a last row a task whose ``counts``
    are the task's counts by id."""

    def run(batches):
        import numpy as np

        code = encoder(path)
        size = np.dtype(code.dtype).itemsize
        end, names = np.array([end_id], code.dtype).tobytes(), ["doc_id", "n_tokens", "ids", "counts"]
        total = np.zeros(max(end_id + 1, code.library.get_vocab_size()), "i8")
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for i, j in chunks(texts):
                ids = [x + end for x in code.encode(texts[i:j])]
                total += np.bincount(np.frombuffer(b"".join(ids), code.dtype), minlength=len(total))
                n = pa.array([len(x) // size for x in ids], pa.int64())
                yield pa.record_batch([b.column(0).slice(i, j - i), n, pa.array(ids, pa.binary()), pa.nulls(j - i, pa.binary())], names)
        none = pa.nulls(1, pa.int64())
        yield pa.record_batch([none, none, pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids binary, counts binary")


def id_ranks(tokens: DataFrame):
    """All ids by descending count, ties to the smaller id. The counts are bounded by
    the vocabulary."""

    def count(batches):
        import numpy as np

        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                got = np.frombuffer(x, "<i8")
                total = got.copy() if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [r.id for r in counts.orderBy(F.desc("n"), "id").select("id").collect()]


def write_token_files(docs: DataFrame, path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"):
    """Write the files and return (folder, manifest rows in id order). Null texts
    count as empty; a null id sorts first. Rows with one id keep all their tokens."""
    spark = docs.sparkSession
    tokens = materialise(tokenised(docs, path, end_id, id_col, text_col), "tokens")
    dtype = encoder(path).dtype
    size = int(dtype[-1])
    ranks = id_ranks(tokens)
    folder = fresh_path(spark, "token-files")
    store, at = open_store(folder)
    store.create_dir(at, recursive=True)
    import numpy as np

    by_rank = np.array(ranks, "<u4")
    with store.open_output_stream(f"{at}/ranks.bin", compression=None) as out:
        out.write(by_rank.tobytes())
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, "<u4")
    rank_of[by_rank] = np.arange(len(by_rank))

    def write(batches):
        import uuid

        import numpy as np
        from pyspark import TaskContext

        part, ids, held, n_docs, n_tokens = TaskContext.get().partitionId(), [], 0, 0, 0
        url = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.blt"
        store, at = open_store(url)
        with store.open_output_stream(at, compression=None) as out:
            out.write(MAGIC)

            def flush():
                values = rank_of[np.frombuffer(b"".join(x for _, x in ids), dtype)]
                control, data = pack(values)
                # null ids sort first, so their number tells which they are
                nulls = sum(k is None for k, _ in ids)
                out.write(struct.pack(HEAD, len(ids), nulls, len(values), len(control), len(data)))
                out.write(np.array([k or 0 for k, _ in ids], "<i8").tobytes())
                out.write(np.array([len(x) // size for _, x in ids], "<u4").tobytes())
                out.write(control)
                out.write(data)

            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids.append((k, x))
                    held += len(x) // size
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(x) // size
                    if held >= BLOCK_VALUES:
                        flush()
                        ids, held = [], 0
            if ids:
                flush()
        row = [[part], [url], [n_docs], [n_tokens]]
        yield pa.record_batch([pa.array(x) for x in row], ["part", "url", "n_docs", "n_tokens"])

    # a number a row parts the rows of one id, however many there are
    ordered = tokens.where("counts IS NULL").select("doc_id", "ids", F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    manifest = materialise(ordered.mapInArrow(write, "part long, url string, n_docs long, n_tokens long"), "token-manifest")
    return folder, [r for r in manifest.orderBy("part").collect() if r.n_docs]


def read_token_files(spark, folder: str, manifest) -> DataFrame:
    """doc_id, start, ids (binary, unsigned 32-bit) of every document in the files: a row
    each for repeated and null ids, the end alone for empty texts, no row for no files."""
    files, start = [], 0
    for r in manifest:
        files.append((r.url, start))
        start += r.n_tokens

    def read(batches):
        import numpy as np

        by_rank = None
        for b in batches:
            for url, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, at = open_store(url)
                if by_rank is None:
                    with store.open_input_stream(f"{at.rpartition('/')[0]}/ranks.bin") as f:
                        by_rank = np.frombuffer(f.read(), "<u4")
                with store.open_input_stream(at, compression=None) as f:
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"not a token file: {url}")
                    while head := f.read(struct.calcsize(HEAD)):
                        n_docs, nulls, n, n_control, n_data = struct.unpack(HEAD, head)
                        keys = np.frombuffer(f.read(8 * n_docs), "<i8")
                        sizes = np.frombuffer(f.read(4 * n_docs), "<u4").astype("i8")
                        ids = by_rank[unpack(f.read(n_control), f.read(n_data), n)].tobytes()
                        ends = np.cumsum(sizes)
                        begins = ends - sizes
                        yield pa.record_batch(
                            [
                                pa.array(keys, mask=np.arange(n_docs) < nulls),
                                pa.array(begins + start),
                                pa.array([ids[4 * i : 4 * j] for i, j in zip(begins.tolist(), ends.tolist())], pa.binary()),
                            ],
                            ["doc_id", "start", "ids"],
                        )
                        start += n

    rows = spark.createDataFrame(files, "url string, start long")
    if files:
        rows = rows.repartition(len(files))
    return rows.mapInArrow(read, "doc_id long, start long, ids binary")


def token_digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents read back, row by row."""
    return read.select(
        "doc_id",
        "start",
        F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
