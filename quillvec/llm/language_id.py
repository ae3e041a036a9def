"""Language identification with a byte convolutional network in numpy.

Bytes are embedded, filters of several widths run over them, each filter keeps
its largest response in a window, and a softmax layer reads those. Training uses
a bounded sample: at most ``PER_LANGUAGE`` texts of each language, two stretches
of each, and with very many languages so few of each that all together stay below
``MOST_TEXTS``; every label is learned. Prediction covers whole texts: a text is cut into windows of fixed
length that overlap by one filter width less one, windows of many texts form one
batch, and the log-probabilities of a text's windows are averaged by length.

Inside a task the filters become two tables over byte pairs, so a window costs
two look-ups and a maximum per byte.

Defined results: null texts and texts without a letter are ``und`` with score 0;
so is every text if there is nothing to learn from; repeated rows are predicted
alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec.llm.common import whole

#: The bounds of the training sample; a language has one text at least.
PER_LANGUAGE, MOST_TEXTS = 400, 40_000
STRETCH = 400
WIDTHS = (2, 3, 4)
REACH = max(WIDTHS)
FILTERS = 16
EMBED = 8
WINDOW = 128
EPOCHS = 12
SEED = 5


class Network(NamedTuple):
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # REACH * EMBED x FILTERS * len(WIDTHS); zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _mask() -> np.ndarray:
    mask = np.zeros((REACH, EMBED, len(WIDTHS), FILTERS), dtype=np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width, :, i] = 1
    return mask.reshape(REACH * EMBED, -1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], seed: int = SEED) -> Network:
    """Adam on windows cut at random places and to random lengths."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    mask = _mask()
    p = {
        "embed": rng.normal(0, 0.3, (256, EMBED)),
        "filters": rng.normal(0, 0.2, mask.shape) * mask,
        "bias": np.zeros(mask.shape[1]),
        "out": rng.normal(0, 0.2, (mask.shape[1], len(languages))),
        "out_bias": np.zeros(len(languages)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    one = {k: np.zeros_like(v) for k, v in p.items()}
    two = {k: np.zeros_like(v) for k, v in p.items()}
    at = {name: i for i, name in enumerate(languages)}
    target = np.array([at[x] for x in labels])
    per = np.bincount(target, minlength=len(languages))
    weight = (len(target) / np.maximum(per, 1) / len(languages))[target].astype(np.float32)
    step, batch = 0, 64
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            data = np.zeros((len(rows), WINDOW + REACH - 1), dtype=np.uint8)
            sizes = np.zeros(len(rows), dtype=np.int64)
            for i, r in enumerate(rows):
                most = int(rng.integers(6, WINDOW + 1))
                first = int(rng.integers(0, max(1, len(texts[r]) - most + 1)))
                piece = texts[r][first : first + most]
                data[i, : len(piece)] = np.frombuffer(piece, dtype=np.uint8)
                sizes[i] = len(piece)
            x = p["embed"][data]
            x = np.concatenate([x[:, k : k + WINDOW] for k in range(REACH)], axis=2)
            z = x @ p["filters"]
            z[np.arange(WINDOW)[None, :] >= np.maximum(sizes, 1)[:, None]] = -1e9
            best = z.argmax(axis=1)
            top = np.take_along_axis(z, best[:, None], 1)[:, 0] + p["bias"]
            pooled = np.maximum(top, 0)
            prob = _softmax(pooled @ p["out"] + p["out_bias"])
            prob[np.arange(len(rows)), target[rows]] -= 1
            d = prob * weight[rows][:, None] / len(rows)
            dtop = (d @ p["out"].T) * (top > 0)
            chosen = x[np.arange(len(rows))[:, None], best]  # rows x filters x REACH * EMBED
            grad = {
                "out": pooled.T @ d,
                "out_bias": d.sum(axis=0),
                "bias": dtop.sum(axis=0),
                "filters": np.einsum("bf,bfk->kf", dtop, chosen) * mask,
            }
            back = (dtop[:, :, None] * p["filters"].T[None]).reshape(-1, REACH, EMBED)
            bytes_ = data[np.arange(len(rows))[:, None, None], best[:, :, None] + np.arange(REACH)]
            grad["embed"] = np.zeros_like(p["embed"])
            np.add.at(grad["embed"], bytes_.reshape(-1, REACH), back)
            step += 1
            for k in p:
                one[k] = 0.9 * one[k] + 0.1 * grad[k]
                two[k] = 0.999 * two[k] + 0.001 * grad[k] ** 2
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                p[k] = (p[k] - rate * one[k] / (np.sqrt(two[k]) + 1e-8)).astype(np.float32)
    return Network(languages, p["embed"], p["filters"], p["bias"], p["out"], p["out_bias"])


class Predictor:
    """A network with its filters spread out over byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        by_byte = [
            net.embed @ net.filters[k * EMBED : (k + 1) * EMBED] for k in range(REACH)
        ]
        self.near, self.far = (
            (by_byte[k][:, None] + by_byte[k + 1][None]).reshape(1 << 16, -1).astype(np.float32)
            for k in (0, 2)
        )

    def _windows(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        pair = data[:, :-1].astype(np.int32) * 256 + data[:, 1:]
        z = self.near[pair[:, :WINDOW]]
        z += self.far[pair[:, 2 : WINDOW + 2]]
        short = np.flatnonzero(sizes < WINDOW)
        for i in short.tolist():
            z[i, sizes[i] :] = -1e9
        pooled = np.maximum(z.max(axis=1) + self.net.bias, 0)
        logits = pooled @ self.net.out + self.net.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def predict(self, texts: list[bytes], batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Place of the likeliest language and its probability, for every text."""
        total = np.zeros((len(texts), len(self.net.languages)))
        weight = np.zeros(len(texts))
        data = np.zeros((batch, WINDOW + REACH - 1), dtype=np.uint8)
        sizes, owner, held = np.zeros(batch, np.int64), np.zeros(batch, np.int64), 0

        def flush(n: int) -> None:
            logs = self._windows(data[:n], sizes[:n])
            np.add.at(total, owner[:n], logs * sizes[:n, None])
            np.add.at(weight, owner[:n], sizes[:n])
            data[:n] = 0

        for i, text in enumerate(texts):
            whole_text = np.frombuffer(text, dtype=np.uint8)
            for at in range(0, len(text), WINDOW):
                # Filters that start in this window look up to REACH - 1 bytes further.
                part = whole_text[at : at + WINDOW + REACH - 1]
                data[held, : len(part)] = part
                sizes[held], owner[held] = min(WINDOW, len(part)), i
                held += 1
                if held == batch:
                    flush(held)
                    held = 0
        flush(held)
        mean = _softmax(total / np.maximum(weight, 1)[:, None])
        return mean.argmax(axis=1), mean.max(axis=1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(labelled: DataFrame, lang: str, text: str, key: str) -> tuple[list[bytes], list[str]]:
    """Texts and labels to learn from: bounded rows, chosen by a hash of the key, two stretches each."""
    # A row per label: labels are the classes of the softmax layer, which holds them all.
    counts = labelled.groupBy(lang).count().orderBy(lang).collect()
    if not counts:
        return [], []
    each = min(PER_LANGUAGE, max(1, MOST_TEXTS // len(counts)))
    # About twice as many as wanted pass by hash; the limits below make the bound exact.
    # A rare label lets all of its rows pass, so that none is missed.
    chance = F.create_map(
        *(
            F.lit(x)
            for r in counts
            for x in (r[lang], 1.0 if r["count"] < 64 else min(1.0, (2.0 * each + 16) / r["count"]))
        )
    )
    drawn = F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(1 << 20)) / (1 << 20)
    length = F.char_length(text)
    later = F.pmod(F.xxhash64(F.lit(SEED + 1), key), F.greatest(length - STRETCH, F.lit(1)))
    drawn_rows = labelled.where(drawn < chance[F.col(lang)]).select(
        F.col(lang).alias("lang"),
        F.xxhash64(F.lit(SEED + 2), key).alias("order"),
        F.substring(text, 1, STRETCH).alias("a"),
        F.substring(F.col(text), (later + 1).cast("int"), F.lit(STRETCH)).alias("b"),
    )
    # About ``2 * each`` rows of a label, or fewer than 64, come to be ranked.
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy("order", "a"))
    few = drawn_rows.withColumn("rank", ranked).where(F.col("rank") <= each)
    texts, labels = [], []
    for r in few.orderBy("lang", "rank").collect():
        texts += [r["a"].encode("utf-8", "ignore"), r["b"].encode("utf-8", "ignore")]
        labels += [r["lang"]] * 2
    return texts, labels


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Network | None:
    labelled = docs.where(
        ~held_out(F.col(key)) & F.col(lang).isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    )
    texts, labels = sample(labelled, lang, text, key)
    return train(texts, labels) if texts else None


def identify(docs: DataFrame, net: Network | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, lang_pred, score``."""
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        held_out(F.col(doc_id)).alias("held_out"),
        F.when(letters, whole(text)).alias("text"),
    )
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(net)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            place, score = predictor.predict([(t or "").encode("utf-8", "ignore") for t in texts])
            names = [net.languages[p] if t else "und" for p, t in zip(place.tolist(), texts, strict=True)]
            scores = [s if t else 0.0 for s, t in zip(score.tolist(), texts, strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
