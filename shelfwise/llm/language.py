"""Language identification with a bidirectional gated recurrent network over bytes (operator 2).

The network reads windows of ``WINDOW`` bytes. At each byte, one recurrent state comes
from the left end of the window and one from its right end; both together label the
position with a probability for each language. A document's probabilities are the normalised
sum of the log-probabilities of all its positions, in all its windows: whole texts are read.

The network is trained here, in numpy, by backpropagation through time with Adam, on a
bounded sample of labelled rows (``PER_LANGUAGE`` documents of each language, taken by a
hash of their id, one stretch of ``STRETCH`` characters each). Its weights are a few
thousand floats that travel with the task.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every
text when no row can be learned from; one learned language is predicted for all texts
with a letter; null ids are never learned from; repeated rows are predicted one by one;
other columns are kept by ``predict`` and ignored by the query.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import table

#: Bytes in a window, size of either recurrent state, windows computed at once.
WINDOW, HIDDEN, TOGETHER = 64, 8, 1_024
#: The training sample: documents of each language, and characters of each.
PER_LANGUAGE, STRETCH = 256, 512
SLICES = 64
#: Training: steps, windows in a step, learning rate, seed.
STEPS, PER_STEP, RATE, SEED = 160, 128, 0.02, 11

UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, stretch: int = STRETCH) -> list[tuple[str, str]]:
    """(lang, text) of at most ``per_language`` labelled rows of each language, in a fixed order."""
    by = ["h", "doc_id", "piece"]
    rows = (
        docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h"),
                # A stretch from anywhere in the text.
                F.expr(f"substring(text, 1 + CAST(pmod(xxhash64(CAST(doc_id AS STRING), 7), greatest(1, length(text) - {stretch})) AS INT), {stretch})").alias("piece"))
        # First in slices of a language, so that no task gets what every task holds of a frequent one.
        .withColumn("n", F.row_number().over(W.partitionBy("lang", F.pmod("h", F.lit(SLICES))).orderBy(*by))).filter(F.col("n") <= per_language)
        .withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(*by))).filter(F.col("n") <= per_language)
    )
    return sorted((r["lang"], r["piece"]) for r in rows.select("lang", "piece").collect())


def _windows(texts: list[bytes], window: int = WINDOW):
    """Bytes as an array of (position, window), how many positions of each window are text, and whose it is."""
    import numpy as np

    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    per = -(-lengths // window)
    owner = np.repeat(np.arange(len(texts)), per)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    filled = np.minimum(window, lengths[owner] - place * window)
    flat = np.frombuffer(b"".join(texts) + bytes(window), np.uint8)
    start = (np.cumsum(lengths) - lengths)[owner] + place * window
    return flat, start, filled, owner


class Network:
    """Two gated recurrent layers, one per direction, and a softmax over both states at each position.

    All gates are scaled so that one tanh serves them: sigmoid(x) = (1 + tanh(x / 2)) / 2."""

    def __init__(self, n_out: int, hidden: int = HIDDEN, seed: int = SEED):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.hidden = hidden
        #: Input, recurrent weights and biases of (update, reset, candidate), by direction.
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
            "u": rng.normal(0, 0.3, (2, hidden, 3 * hidden)).astype(np.float32),
            "o": rng.normal(0, 0.3, (2 * hidden, n_out)).astype(np.float32),
            "b": np.zeros(n_out, np.float32),
        }

    def _run(self, codes, d: int, keep: bool):
        """States of direction ``d`` after each position of ``codes`` (position, window); with what the way back needs."""
        import numpy as np

        h_, x, u = self.hidden, self.p["x"][d], self.p["u"][d]
        steps, n = codes.shape
        h = np.zeros((n, h_), np.float32)
        states, tape = np.empty((steps, n, h_), np.float32), []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = np.take(x, codes[t], axis=0)
            r = h @ u
            gates = a[:, :2 * h_] + r[:, :2 * h_]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, reset = gates[:, :h_], gates[:, h_:]
            c = reset * r[:, 2 * h_:]
            c += a[:, 2 * h_:]
            np.tanh(c, out=c)
            if keep:
                tape.append((t, h, z, reset, c, r[:, 2 * h_:]))
            new = c - h
            new *= z
            h = np.add(h, new, out=states[t])
        return states, tape

    def log_probabilities(self, codes, keep: bool = False):
        """(position, window, language), with the states and tapes of both directions."""
        import numpy as np

        runs = [self._run(codes, d, keep) for d in (0, 1)]
        h = self.hidden
        logits = runs[0][0].reshape(-1, h) @ self.p["o"][:h]
        logits += runs[1][0].reshape(-1, h) @ self.p["o"][h:]
        logits += self.p["b"]
        # One shift for all positions is enough: states lie in (-1, 1), so logits are bounded by the weights.
        logits -= logits.max()
        logits -= np.log(np.maximum(np.exp(logits) @ np.ones((logits.shape[1], 1), logits.dtype), 1e-30))
        return logits.reshape(*codes.shape, -1), runs

    def gradients(self, codes, filled, target):
        """Mean loss over the text's positions, and its gradients by backpropagation through time."""
        import numpy as np

        h_, (steps, n) = self.hidden, codes.shape
        logp, runs = self.log_probabilities(codes, keep=True)
        on = (np.arange(steps)[:, None] < filled[None, :]).astype(np.float32)
        total = on.sum()
        loss = -(logp[:, np.arange(n), target] * on).sum() / total
        dl = np.exp(logp)
        dl[:, np.arange(n), target] -= 1
        dl *= on[:, :, None] / total
        flat = dl.reshape(steps * n, -1)
        both = np.concatenate([runs[0][0], runs[1][0]], 2).reshape(steps * n, -1)
        grads = {"o": both.T @ flat, "b": flat.sum(0), "x": np.zeros_like(self.p["x"]), "u": np.zeros_like(self.p["u"])}
        for d in (0, 1):
            u = self.p["u"][d]
            from_out = (flat @ self.p["o"][d * h_:(d + 1) * h_].T).reshape(steps, n, h_)
            dh = np.zeros((n, h_), np.float32)
            for t, h, z, reset, c, rc in reversed(runs[d][1]):
                dh = dh + from_out[t]
                dc = dh * z * (1 - c * c)
                # The gates are (1 + tanh) / 2: their slope is 2 g (1 - g).
                dz = dh * (c - h) * 2 * z * (1 - z)
                dr = dc * rc * 2 * reset * (1 - reset)
                da = np.concatenate([dz, dr, dc], 1)
                dru = np.concatenate([dz, dr, dc * reset], 1)
                np.add.at(grads["x"][d], codes[t], da)
                grads["u"][d] += h.T @ dru
                dh = dh * (1 - z) + dru @ u.T
        return loss, grads


def train(sample: list[tuple[str, str]], steps: int = STEPS, per_step: int = PER_STEP, rate: float = RATE,
          seed: int = SEED) -> tuple[list[str], Network | None]:
    """The languages in order, and the network that tells them apart (none when there is nothing to learn)."""
    import numpy as np

    languages = sorted({lang for lang, _ in sample})
    texts = [t.encode() for _, t in sample]
    flat, start, filled, owner = _windows(texts)
    if not languages or not len(start):
        return [], None
    net = Network(len(languages), seed=seed)
    label = np.array([languages.index(lang) for lang, _ in sample])[owner]
    by_language = [np.flatnonzero(label == k) for k in range(len(languages)) if (label == k).any()]
    rng = np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        # As many windows of each language.
        pick = np.concatenate([rng.choice(own, max(1, per_step // len(by_language))) for own in by_language])
        codes = flat[start[pick][None, :] + np.arange(WINDOW)[:, None]]
        _, grads = net.gradients(codes, filled[pick], label[pick])
        for k, g in grads.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            net.p[k] -= rate * (1 - 0.9 * step / steps) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return languages, net


def pooled(net: Network, texts: list[bytes], n_out: int):
    """Probabilities (text, language): log-probabilities of all positions of all windows, added up and normalised; and the share of
    positions that are labelled with the most probable language."""
    import numpy as np

    flat, start, filled, owner = _windows(texts)
    total, labelled = np.zeros((len(texts), n_out)), np.zeros((len(texts), n_out))
    for k in range(0, len(start), TOGETHER):
        codes = flat[start[k:k + TOGETHER][None, :] + np.arange(WINDOW)[:, None]]
        logp, _ = net.log_probabilities(codes)
        top = logp[:, :, 0].copy()
        for c in range(1, n_out):
            np.maximum(top, logp[:, :, c], out=top)
        on = np.arange(WINDOW)[:, None] < filled[None, k:k + TOGETHER]
        logp *= on[:, :, None]
        top[~on] = 1
        sums, own = logp.sum(0), owner[k:k + TOGETHER]
        for c in range(n_out):
            total[:, c] += np.bincount(own, weights=sums[:, c], minlength=len(texts))
            labelled[:, c] += np.bincount(own, weights=(logp[:, :, c] == top).sum(0), minlength=len(texts))
    odds = np.exp(total - total.max(1, keepdims=True))
    share = labelled[np.arange(len(texts)), total.argmax(1)] / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))
    return odds / odds.sum(1, keepdims=True), share


def predict(docs: DataFrame, languages: list[str], net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the pooled probability of the predicted language) and ``agreement`` (the
    share of positions that are labelled with it; null where nothing is predicted)."""
    docs = docs.drop("lang_pred", "score", "agreement")
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        import numpy as np
        import regex

        letter = regex.compile(r"\p{L}").search
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [t if t and letter(t) else "" for t in part.column(names.index(text_col)).to_pylist()]
                if net is None:
                    pred, score, agreement = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
                else:
                    odds, agreement = pooled(net, [t.encode() for t in texts], len(languages))
                    pred = [languages[b] if t else UNKNOWN for b, t in zip(odds.argmax(1), texts)]
                    score = np.where([bool(t) for t in texts], odds.max(1), 0.0)
                    agreement = [float(a) if t else None for a, t in zip(agreement, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                                  pa.array(agreement, pa.float64())], names=[*names, "lang_pred", "score", "agreement"])

    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, agreement double")


def lettered(text: Column) -> Column:
    """Texts that hold a letter."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def in_learned_language(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """``docs`` without those that the network rejects; a null ``lang`` becomes the predicted one.

    A document stays when its predicted language is one of ``wanted`` (default: all learned ones) and its positions are
    labelled with it as often as a guess among the learned languages would give, less what chance takes off (the root of the
    number of positions, so that a text of a few letters is not rejected for them). Texts without a letter go. When no row can be learned from nothing
    is predicted, and every text with a letter stays."""
    languages, net = fitted(docs)
    if net is None:
        return docs.filter(lettered(F.col("text")))
    share = F.col("agreement") + 1 / F.sqrt(F.greatest(F.octet_length("text"), F.lit(1)))
    kept = predict(docs, languages, net).filter(
        (F.col("lang_pred") != UNKNOWN) & F.col("lang_pred").isin(wanted or languages) & (share * len(languages) >= 1))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def fitted(docs: DataFrame) -> tuple[list[str], Network | None]:
    return train(training_sample(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = predict(docs.select("doc_id", "text"), *fitted(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
