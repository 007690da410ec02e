"""Language identification by a byte convolutional network trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import flat_text, in_pieces, pack, q, rows_of

WIDTHS = (2, 3, 4)  # bytes a filter spans
FILTERS = 16  # filters of each width
WINDOW = 256  # bytes the network sees at a time; windows overlap by what the widest filter needs
STRIDE = WINDOW - max(WIDTHS) + 1
SAMPLE_PER_LANGUAGE = 400  # documents learned from, per language at most
SAMPLE_ROWS = 8_000  # and in all
SAMPLE_CHARS = 512  # code points taken from a random place of each
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.02, 1
BATCH_BYTES = 1 << 20
UNKNOWN = "und"
OUT = ["lang_pred", "score"]


def _windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions of every window (a zero byte after the end of its text is at `len(data)`), its text, and its bytes."""
    size = np.diff(off)
    n = np.maximum(1, -(-(size - (WINDOW - STRIDE)) // STRIDE))
    text = rows_of(n)
    start = off[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    end = off[text + 1]
    return start, text, np.minimum(end - start, WINDOW)


def _bytes(padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    at[np.arange(WINDOW) >= size[:, None]] = len(padded) - 1
    return padded[at]


def train(texts: list[bytes], labels: list[int], classes: int) -> dict[str, np.ndarray]:
    """Filters over one-hot bytes, max pooling, ReLU and softmax, fitted with Adam on random crops of the texts."""
    rng = np.random.default_rng(SEED)
    y = np.array(labels)
    par = {f"w{w}": rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    par |= {"b": np.zeros(FILTERS * len(WIDTHS), np.float32), "v": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), classes)).astype(np.float32), "c": np.zeros(classes, np.float32)}
    mean = {k: np.zeros_like(p) for k, p in par.items()}
    square = {k: np.zeros_like(p) for k, p in par.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            x = np.zeros((len(pick), WINDOW), np.uint8)
            for r, i in enumerate(pick):  # crops of many lengths, so that short texts are known too
                t = texts[i]
                n = min(len(t), int(WINDOW * rng.uniform(0.05, 1) if rng.random() < 0.5 else WINDOW))
                s = int(rng.integers(0, len(t) - n + 1))
                part = t[s:s + n]
                x[r, :n] = np.frombuffer(part.upper() if rng.random() < 0.1 else part, np.uint8)
            pooled, where = [], []
            for w in WIDTHS:
                act = sum(par[f"w{w}"][j][x[:, j:j + STRIDE]] for j in range(w))
                top = act.argmax(axis=1)
                where.append(top)
                pooled.append(np.take_along_axis(act, top[:, None], 1)[:, 0])
            h = np.concatenate(pooled, axis=1) + par["b"]
            z = np.maximum(h, 0)
            p = softmax(z @ par["v"] + par["c"])
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            dh = (p @ par["v"].T) * (h > 0)
            grad = {"v": z.T @ p, "c": p.sum(0), "b": dh.sum(0)}
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(par[f"w{w}"])
                d = dh[:, k * FILTERS:(k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, where[k] + j, 1), np.arange(FILTERS)), d)
                grad[f"w{w}"] = g
            step += 1
            for k, g in grad.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                par[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return par


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def byte_pair_tables(par: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The filters' sums for every pair of bytes: bytes 0 and 1 of all widths, bytes 2 and 3 of the wider ones."""
    head = np.concatenate([(par[f"w{w}"][0][:, None] + par[f"w{w}"][1][None]).reshape(65536, -1) for w in WIDTHS], axis=1)
    tail = np.concatenate([np.repeat(par["w3"][2], 256, axis=0), (par["w4"][2][:, None] + par["w4"][3][None]).reshape(65536, -1)], axis=1)
    return head, tail


def predict(par: dict[str, np.ndarray], tables: tuple[np.ndarray, np.ndarray], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Class shares of every whole text: the mean over its windows, weighted by their bytes."""
    head, tail = tables
    padded = np.append(data, np.uint8(0))
    start, text, size = _windows(data, off)
    out = np.zeros((len(off) - 1, len(par["c"])))
    for lo in range(0, len(start), 256):
        part = slice(lo, lo + 256)
        x = _bytes(padded, start[part], size[part]).astype(np.int32)
        pair = x[:, :-1] * 256 + x[:, 1:]
        act = head[pair[:, :STRIDE]]
        act[:, :, FILTERS:] += tail[pair[:, 2:2 + STRIDE]]
        h = np.maximum(act.max(axis=1) + par["b"], 0)
        p = softmax(h @ par["v"] + par["c"]) * np.maximum(size[part], 1)[:, None]
        np.add.at(out, text[part], p)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


def held_out(id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is a multiple of 5. A null id is held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(df: DataFrame, id: str, text: str, lang: str) -> list:
    """At most SAMPLE_PER_LANGUAGE pieces of each language's documents, the same on every run."""
    known = df.where(q(lang).isNotNull() & ~held_out(q(id)) & q(text).isNotNull())
    counts = known.groupBy(q(lang).alias("lang")).count().limit(SAMPLE_ROWS + 1).collect()
    if len(counts) > SAMPLE_ROWS // 2:
        raise ValueError(f"more than {SAMPLE_ROWS // 2} languages")
    if not counts:
        return []
    most = min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(counts))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 2.0 * most / r["count"])])
    mark = F.xxhash64(q(id), q(text))
    d = known.select(q(lang).alias("lang"), mark.alias("mark"), q(text).alias("text")).where(
        F.pmod("mark", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    place = F.pmod(F.xxhash64("mark"), F.greatest(F.char_length("text") - SAMPLE_CHARS + 1, F.lit(1)))
    d = d.select("lang", "mark", F.substring("text", (place + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("piece")).where("piece <> ''")
    first = Window.partitionBy("lang").orderBy("mark", "piece")
    return sorted(d.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).select("lang", "mark", "piece").collect())


def _label(model, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for b in in_pieces(batches, "__text", BATCH_BYTES):
            known = b.column("__letter").to_numpy(zero_copy_only=False).astype(bool)
            pred = np.full(b.num_rows, UNKNOWN, object)
            score = np.zeros(b.num_rows)
            if model is not None:
                names, par = model.value
                tables = tables or byte_pair_tables(par)
                share = predict(par, tables, *flat_text(b.column("__text")))
                best = share.argmax(axis=1)
                pred = np.where(known, np.array(names, object)[best], UNKNOWN)
                score = np.where(known, share[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([b.column("__in"), pa.array(pred, pa.string()), pa.array(np.clip(score, 0.0, 1.0))], schema=schema)
    return run


def identify_language(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Add `lang_pred` and `score` (0 to 1) to every row.

    The network learns from a sample of rows with a language, bounded by
    SAMPLE_PER_LANGUAGE and SAMPLE_ROWS, that are not `held_out`; it sees text only.
    Every whole text is then cut into windows of WINDOW bytes whose class shares are
    averaged. A null text, an empty one and one without a letter is `und` with score 0,
    as is everything when nothing is labelled. Equal texts get equal answers. `keep`
    names the input columns to carry (default all); those named like an output are
    replaced. An empty table gives an empty result. Prediction has no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    sample = labelled_sample(df, id, text, lang)
    model = None
    if sample:
        names = sorted({r["lang"] for r in sample})
        par = train([r["piece"].encode() for r in sample], [names.index(r["lang"]) for r in sample], len(names))
        model = df.sparkSession.sparkContext.broadcast((names, par))
    whole, columns = pack(df, OUT, keep)
    d = df.select(whole, q(text).alias("__text"), F.coalesce(q(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = T.StructType([d.schema["__in"]] + T._parse_datatype_string("lang_pred string, score double").fields)
    return d.mapInArrow(_label(model, to_arrow_schema(schema)), schema).select(*columns, *OUT)
