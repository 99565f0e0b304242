"""Language ID: a byte convolutional network, trained here in numpy, over fixed-length windows of whole texts.

Bytes have learned vectors; filters of several widths slide over them; each filter's largest value in a window, after
a ReLU, feeds a softmax over the languages. A text's windows cover it end to end, the last padded with zero bytes, and
the mean of their log-probabilities, weighted by the bytes in them, decides.

Learns from a bounded sample: at most ``per_language`` documents of each language, ``all_samples`` in all, taken by a
hash of the id among the documents whose crc32 of the id's decimal form leaves a remainder of ``modulus`` other than
``held_out``, and up to 6 windows of each, spread over the text. Prediction uses the text alone.

A null text, or one without letters, is ``und`` with score 0. Without any labelled text all are. Labels that are null or
blank teach nothing. Rows are independent; repeated rows get equal answers. Other columns don't matter.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import bounded, tidy
from panelspark.llm.tokens import text_buffer

WINDOW, WIDTHS, FILTERS, VECTOR = 256, (2, 3, 4), 16, 8
PER_LANGUAGE, ALL_SAMPLES, STEPS, BATCH, SEED = 500, 4000, 1000, 64, 20
MODULUS, HELD_OUT = 4, 2
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _windows(texts: list[bytes], most: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` windows of each text, some of them short, and the text each comes from."""
    out, of = [], []
    for k, t in enumerate(texts):
        room = max(0, len(t) - WINDOW)
        for at in sorted({0, room, *(int(x) for x in rng.integers(0, room + 1, most - 2))})[:most]:
            piece = t[at : at + (WINDOW if rng.random() < 0.8 else int(rng.integers(24, WINDOW)))]
            out.append(np.frombuffer(piece.ljust(WINDOW, b"\0"), np.uint8))
            of.append(k)
    return np.array(out, np.uint8).reshape(-1, WINDOW), np.array(of, np.int64)


class Network:
    """Byte vectors, filters of each width, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"byte": rng.normal(0, 0.5, (256, VECTOR))}
        for w in WIDTHS:
            self.p[f"filter{w}"] = rng.normal(0, (2 / (w * VECTOR)) ** 0.5, (w * VECTOR, FILTERS))
            self.p[f"bias{w}"] = np.zeros(FILTERS)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        self.p["out_bias"] = np.zeros(len(languages))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        vec = p["byte"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            cols = np.concatenate([vec[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            z = cols @ p[f"filter{w}"]
            top = z.argmax(1)
            best = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + p[f"bias{w}"]
            pooled.append(np.maximum(best, 0))
            kept.append((cols, top, best > 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ p["out"] + p["out_bias"]
        z -= z.max(1, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        prob /= n
        g = {"out": h.T @ prob, "out_bias": prob.sum(0), "byte": np.zeros_like(p["byte"])}
        dh = prob @ p["out"].T
        for k, w in enumerate(WIDTHS):
            cols, top, live = kept[k]
            d = dh[:, k * FILTERS : (k + 1) * FILTERS] * live
            at = np.take_along_axis(cols, top[:, :, None], 1)  # n, filters, w * vector
            g[f"filter{w}"] = np.einsum("nf,nfc->cf", d, at)
            g[f"bias{w}"] = d.sum(0)
            back = (d[:, :, None] * p[f"filter{w}"].T[None]).reshape(n, FILTERS, w, VECTOR)
            bytes_at = x[np.arange(n)[:, None, None], top[:, :, None] + np.arange(w)]
            np.add.at(g["byte"], bytes_at.ravel(), back.reshape(-1, VECTOR))
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        """Adam; each batch has the languages in equal parts as far as it can."""
        rng = np.random.default_rng(seed + 1)
        groups = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            pick = np.array([rng.choice(groups[k]) for k in rng.permutation(np.arange(BATCH) % len(groups))])
            rate = 0.01 * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, g in self.gradients(x[pick], y[pick]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What a pair of bytes adds to each filter at the filter's start, and the pair after it to the wider ones."""
        one = {(w, j): self.p["byte"] @ self.p[f"filter{w}"][j * VECTOR : (j + 1) * VECTOR] for w in WIDTHS for j in range(w)}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        none = np.zeros((256, FILTERS), np.float32)
        get = lambda w, j: one.get((w, j), none)
        near = np.concatenate([pair(get(w, 0), get(w, 1)) for w in WIDTHS], axis=1)
        far = np.concatenate([pair(get(w, 2), get(w, 3)) for w in WIDTHS if w > 2], axis=1)
        return near.astype(np.float32), far.astype(np.float32)


class Predictor:
    """A network with its tables, for many windows."""

    def __init__(self, network: Network):
        self.languages, p = network.languages, network.p
        self.near, self.far = network.tables()
        self.narrow = FILTERS * sum(w <= 2 for w in WIDTHS)
        self.bias = np.concatenate([p[f"bias{w}"] for w in WIDTHS])
        self.out, self.out_bias = p["out"], p["out_bias"]

    def log_probabilities(self, windows: np.ndarray, step: int = 192) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)))
        for a in range(0, len(windows), step):
            x = windows[a : a + step].astype(np.int32)
            two = x[:, :-1] * 256 + x[:, 1:]
            z = self.near[two]
            z[:, :-2, self.narrow :] += self.far[two[:, 2:]]
            # filters never reach past the window: a width of w has WINDOW - w + 1 places
            h = np.concatenate([z[:, : WINDOW - w + 1, k * FILTERS : (k + 1) * FILTERS].max(1) for k, w in enumerate(WIDTHS)], axis=1)
            y = np.maximum(h + self.bias, 0) @ self.out + self.out_bias
            y -= y.max(1, keepdims=True)
            out[a : a + step] = y - np.log(np.exp(y).sum(1, keepdims=True))
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        data, offsets = text_buffer(texts)
        sizes = np.diff(offsets)
        count = -(-sizes // WINDOW)
        at = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(int(at[-1]) * WINDOW, np.uint8)
        for k in np.flatnonzero(count).tolist():
            flat[at[k] * WINDOW : at[k] * WINDOW + sizes[k]] = data[offsets[k] : offsets[k + 1]]
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        has = letters[offsets[1:]] > letters[offsets[:-1]]
        for k in np.flatnonzero(~has & (sizes > 0)).tolist():
            has[k] = any(c.isalpha() for c in texts[k].as_py())
        if not self.languages:
            return ["und"] * len(sizes), np.zeros(len(sizes))
        logs = self.log_probabilities(flat.reshape(-1, WINDOW))
        weight = np.full(len(logs), WINDOW, float)
        full = np.flatnonzero(count)
        weight[at[1:][full] - 1] = sizes[full] - (count[full] - 1) * WINDOW
        mean = np.full((len(sizes), len(self.languages)), -np.inf)
        mean[full] = np.add.reduceat(logs * weight[:, None], at[:-1][full]) / sizes[full, None] if len(full) else 0
        best = mean.argmax(1)
        score = np.zeros(len(sizes))
        top = mean[full]
        score[full] = 1 / np.exp(top - top.max(1, keepdims=True)).sum(1)
        score[~has] = 0
        return [self.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())], score


@functools.lru_cache(maxsize=2)
def _predictor(packed: bytes) -> Predictor:
    network = Network.__new__(Network)
    network.languages, network.p = pickle.loads(packed)
    return Predictor(network)


def _held(modulus: int, held_out: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out, F.lit(False))


def fit(docs: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT, per_language: int = PER_LANGUAGE, all_samples: int = ALL_SAMPLES, seed: int = SEED) -> Network:
    """A network trained on the sample that the module's text describes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~_held(modulus, held_out) & F.col("text").isNotNull() & (F.trim("lang") != ""))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return Network([], seed)
    each = max(1, min(per_language, all_samples // len(counts)))
    span = 1 << 30
    bound = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(span, int(span * 1.3 * each / n) + 1))))
    place = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(span))
    size, part = F.length("text"), WINDOW * 2
    pieces = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.substring(F.col("text"), (F.greatest(F.lit(0), size - part) * k / 5).cast("int") + 1, F.lit(part)))
    some = rows.where(place < bound[F.col("lang")]).select("lang", place.alias("place"), pieces.alias("pieces"))
    own = Window.partitionBy("lang").orderBy("place", "pieces")
    chosen = some.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= each).drop("rank").collect()
    languages = sorted({r["lang"] for r in chosen})
    rng = np.random.default_rng(seed)
    found, label = [], []
    for r in sorted(chosen, key=lambda r: (r["place"], r["lang"], r["pieces"])):
        w, _ = _windows([x.encode() for x in dict.fromkeys(r["pieces"])], 2, rng)
        found.append(w)
        label += [languages.index(r["lang"])] * len(w)
    network = Network(languages, seed)
    if len(languages) > 1:
        network.train(np.concatenate(found), np.array(label), seed=seed)
    return network


def predicted(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of each row's text added."""
    packed = pickle.dumps((network.languages, network.p))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _predictor(packed)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                t = b.slice(a, 256)
                lang, score = model.predict(t.column(names.index(text)))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return bounded(docs).mapInArrow(tidy(run, _predictor), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT) -> DataFrame:
    """Each row's ``doc_id, held_out, lang_pred, score``."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = predicted(thin, fit(docs, modulus, held_out))
    return out.select("doc_id", _held(modulus, held_out).alias("held_out"), "lang_pred", "score")
