"""Media columns: bytes kept as lossless WebP images, and images read to pixel arrays.

A payload's bytes are the samples of its pixels (blue, green, red, alpha, row by row). Long ones are several
images, one file after the other, so that memory is bounded by the image and not by the text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.llm import webp
from itemforge.llm.shared import BATCH_BYTES, pick
from itemforge.llm.textkit import column_bytes

#: Payloads are filled up with zeros to a positive multiple of so many bytes.
ALIGN = 64
#: Pixels of an image at most, its width, and the width of those that would be higher than the format allows.
PAGE, NARROW, WIDE, MOST_ROWS = 1 << 20, 16, 64, 1 << 14
#: Bits of the colour cache of stored payloads, and pixels that a colour stands for on average where a palette is worth it.
CACHE, PALETTE_USE = 6, 4
#: Bytes of payloads that are written together.
TOGETHER = 1 << 18
#: First pixels that tell whether counting the colours is worth it.
HEAD = 64


def payload_size(n_bytes: Column) -> Column:
    return (F.greatest(F.lit(1), F.ceil(n_bytes / ALIGN)) * ALIGN).cast("long")


def page_images(parts: list[np.ndarray]) -> list[bytes]:
    """An image of each of these rows of pixels; an image's last row is filled up with zeros."""
    images = []
    for part in parts:
        width = NARROW if len(part) <= NARROW * MOST_ROWS else WIDE
        images.append(np.pad(part, (0, -len(part) % width)).reshape(-1, width) if len(part) % width else part.reshape(-1, width))
    few = [len(p) > HEAD and len(set(p[:HEAD].tolist())) * PALETTE_USE <= HEAD and len(np.unique(p)) <= min(256, len(p) // PALETTE_USE) for p in parts]
    texts = iter(webp.encode_texts([i for i, f in zip(images, few, strict=True) if not f], CACHE))
    return [webp.encode(i, ((webp.PALETTE,),)) if f else next(texts) for i, f in zip(images, few, strict=True)]


def stored(payload: bytes) -> bytes:
    """A payload, whose length is a multiple of four, as images one after the other."""
    pixels = np.frombuffer(payload, "<u4")
    return b"".join(page_images([pixels[i : i + PAGE]])[0] for i in range(0, len(pixels), PAGE))


def stored_each(payloads: Iterable[bytes]) -> Iterator[bytes]:
    """``stored`` of each, short ones together."""
    waiting, load = [], 0
    for payload in payloads:
        if load + len(payload) > TOGETHER:
            yield from page_images(waiting)
            waiting, load = [], 0
        if len(payload) > TOGETHER:
            yield stored(payload)
        else:
            waiting.append(np.frombuffer(payload, "<u4"))
            load += len(payload)
    yield from page_images(waiting)


def files(raw: bytes) -> list[bytes]:
    """The files that stand one after the other; bytes that are no whole file are one broken file."""
    out, at = [], 0
    while at < len(raw) or not out:
        size = 8 + int.from_bytes(raw[at + 4 : at + 8], "little")
        size += size & 1
        out.append(raw[at : at + size])
        at += size
    return out


def samples_of(raw: bytes) -> tuple[list[int], list[int], bytes]:
    """(widths, heights, samples) of the images."""
    return shaped([webp.decode(f) for f in files(raw)])


def samples_each(raws: Iterable[bytes | None]) -> Iterator[tuple[list[int], list[int], bytes] | webp.NotLossless | None]:
    """``samples_of`` each, or why there are none; None where there are no bytes."""
    counts: deque[int] = deque()

    def each():
        for raw in raws:
            parts = files(raw) if raw else []
            counts.append(len(parts))
            yield from parts
        counts.append(0)

    images, pages = [], webp.decode_each(each())
    for page in pages:
        while not counts[0]:
            counts.popleft()
            yield None
        images.append(page)
        if len(images) == counts[0]:
            counts.popleft()
            broken = [i for i in images if isinstance(i, webp.NotLossless)]
            yield broken[0] if broken else shaped(images)
            images = []
    while len(counts) > 1:
        counts.popleft()
        yield None


def shaped(images: list[np.ndarray]) -> tuple[list[int], list[int], bytes]:
    """(widths, heights, samples) of images."""
    return [i.shape[1] for i in images], [i.shape[0] for i in images], b"".join(i.astype("<u4", copy=False).tobytes() for i in images)


def feature(widths: list[int], heights: list[int], raw: bytes) -> str:
    """Images and first size, means of the four samples in hundredths, and how many neighbouring pixels differ."""
    four = np.frombuffer(raw, np.uint8).reshape(-1, 4)
    means = four.sum(axis=0, dtype=np.int64) * 100 // len(four)
    pixels = np.frombuffer(raw, "<u4")
    return f"{len(widths)}:{widths[0]}x{heights[0]}:{','.join(map(str, means.tolist()))}:{int((pixels[1:] != pixels[:-1]).sum())}"


def each_row(batches, kinds, work):
    """Batches of about ``BATCH_BYTES`` from what ``work`` makes of each batch's rows: (row, bytes it weighs)."""
    import pyarrow as pa

    for b in batches:
        rows, load = [], 0
        for row, size in work(b):
            rows.append(row)
            load += size
            if load >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                rows, load = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes as images.

    Null and empty texts are 64 zeros; equal texts are equal media, whatever stands beside them; null ids stay.
    ``id_col`` holds integers; further columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        def work(b):
            data, off = column_bytes(b.column("text"))
            spans = list(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
            media = stored_each(data[at:end].tobytes() + bytes(-(end - at) % ALIGN if end > at else ALIGN) for at, end in spans)
            for i, (at, end), raw in zip(b.column("id").to_pylist(), spans, media, strict=True):
                yield {"id": i, "n_bytes": end - at, "media": raw}, len(raw)

        yield from each_row(batches, pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())]), work)

    rows = pick(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_images(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with widths, heights, samples, feature and error of its images.

    ``samples`` are four bytes a pixel, row by row, image after image. Where the bytes are null, empty, broken, or no lossless
    WebP the first four are null and ``error`` says why. The names of the new columns must be free.
    """

    def run(batches):
        import pyarrow as pa

        def work(b):
            rest = b.drop_columns([media_col]).to_pylist() if b.num_columns > 1 else [{}] * b.num_rows
            raws = b.column(media_col).to_pylist()
            for row, raw, found in zip(rest, raws, samples_each(raws), strict=True):
                out = {**row, media_col: raw, "widths": None, "heights": None, "samples": None, "feature": None, "error": "no bytes"}
                if isinstance(found, webp.NotLossless):
                    out["error"] = str(found)
                elif found:
                    widths, heights, four = found
                    out |= {"widths": widths, "heights": heights, "samples": four, "feature": feature(widths, heights, four), "error": None}
                yield out, len(raw or b"") + len(out["samples"] or b"")

        for b in batches:
            kinds = pa.schema([*b.schema, ("widths", pa.list_(pa.int32())), ("heights", pa.list_(pa.int32())), ("samples", pa.binary()), ("feature", pa.string()), ("error", pa.string())])
            yield from each_row([b], kinds, work)

    new = "widths array<int>, heights array<int>, samples binary, feature string, error string"
    names = [f.name for f in df.schema]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{fields}, {new}")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as images, read back, and digested: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""
    back = read_images(store_texts(docs, id_col, text_col)).withColumn("payload_bytes", payload_size(F.col("n_bytes")))
    payload = F.expr("substring(samples, 1, CAST(payload_bytes AS INT))")
    tail = F.expr(f"substring(samples, CAST(payload_bytes - {ALIGN - 1} AS INT), {ALIGN})")
    digest = F.struct(F.sha2(payload, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return back.select(id_col, "n_bytes", "payload_bytes", digest.alias("d"), "feature").select(id_col, "n_bytes", "payload_bytes", "d.*", "feature")
