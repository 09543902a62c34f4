"""Language ID by hierarchical discrimination.

First the family (Germanic, Romance, ...) is predicted by one linear classifier per family, then one-versus-one linear
support vector machines decide between the languages of that family. Features are byte 2- and 3-grams of the whole
lower-cased text, everything but letters taken as a space, hashed into 5,120 counts, square roots, unit length.

The classifiers are fitted on a bounded sample: the rows with a language are dealt by a hash of doc_id into as many bins
per language as the sample may have, and one row of each bin is taken, that with the smallest hashes of doc_id and text
(at most `SAMPLE_PER_LANG` a language and `SAMPLE_ROWS` in all, shared out over all languages; of repeated rows one). Every
language is learned; only a column with more than `SAMPLE_ROWS` different values, more than there are languages, can't be
held by the sample, and then its most frequent ones are, by count, then name. Counting languages, taking the sample and
predicting cover all rows. Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from.

Families are those of `FAMILIES`, for two- and three-letter codes, whatever their case and region (`en-GB`, `ENG`).
Languages with other codes form the family `other`. A family of more than `FAMILY_SIZE` languages is divided by the mean
features of these, around the two that are farthest apart, until each part is small enough, so that one-versus-one
classifiers grow with the number of languages and not with its square.

The score is the family's probability times the mean probability of the language against each sibling, by margins
calibrated on the sample. Families of equal probability: the first by name. Languages of equal votes: the higher mean
probability, then the first by name. Null texts, and texts without a letter, are `und` with score 0, and so is every text
when nothing can be learned. Very long texts are read whole, in pieces. Other columns pass through nowhere: the result is keyed by doc_id; repeated rows are predicted each.

As a filter (`keep_identified`): rows without a letter go, and rows whose score lies below a rejection score. That is
calibrated on the sample: classifiers of one half score the other, and `REJECT` times the lowest score there is the bound,
so only texts much less certain than any labelled one are rejected. When nothing can be learned, rows with a letter stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import ship, table

SAMPLE_PER_LANG = 512
SAMPLE_ROWS = 6144
FAMILY_SIZE = 12
#: Share of the lowest score of labelled rows below which a text is in no known language.
REJECT = 0.9
UND = "und"
#: Language codes of two and three letters by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "fo", "yi",
                 "eng", "deu", "ger", "nld", "dut", "swe", "dan", "nor", "nob", "nno", "isl", "ice", "afr", "fry", "ltz", "fao", "yid"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc",
                "fra", "fre", "spa", "ita", "por", "ron", "rum", "cat", "glg", "oci"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs",
               "rus", "ukr", "bel", "pol", "ces", "cze", "slk", "slo", "bul", "srp", "hrv", "slv", "mkd", "mac", "bos"),
    "uralic": ("fi", "et", "hu", "fin", "est", "hun"),
    "baltic": ("lt", "lv", "lit", "lav"),
    "turkic": ("tr", "az", "kk", "uz", "tur", "aze", "kaz", "uzb"),
    "indic": ("hi", "bn", "mr", "ne", "ur", "pa", "gu", "hin", "ben", "mar", "nep", "urd", "pan", "guj"),
    "semitic": ("ar", "he", "mt", "ara", "heb", "mlt"),
}
OTHER = "other"
DIM2, DIM3 = 1024, 4096
DIM = DIM2 + DIM3
#: Letters as themselves (bytes of other alphabets too), all else as a space.
_CLASS = np.array([b if chr(b).isascii() and chr(b).isalpha() or b >= 128 else 32 for b in range(256)], dtype=np.int32)


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, langs in FAMILIES.items() if code in langs), OTHER)


def families_of(x: np.ndarray, langs: list[str]) -> dict[str, list[str]]:
    """The languages of each family, large families divided by the languages' mean features."""
    names, lang = sorted(set(langs)), np.array(langs)
    known: dict[str, list[str]] = {}
    for v in names:
        known.setdefault(family_of(v), []).append(v)
    out: dict[str, list[str]] = {}
    waiting = sorted(known.items(), reverse=True)
    while waiting:
        name, own = waiting.pop()
        if len(own) <= FAMILY_SIZE:
            out[name] = own
            continue
        means = np.array([x[lang == v].mean(axis=0, dtype=np.float64) for v in own])
        near = means @ means.T / np.maximum(np.outer(*[np.linalg.norm(means, axis=1)] * 2), 1e-12)
        a, b = np.unravel_index(np.argmin(near), near.shape)
        first = near[:, a] >= near[:, b]
        if first.all() or not first.any():
            first = np.arange(len(own)) < len(own) // 2
        waiting += [(f"{name}.2", [v for v, f in zip(own, first, strict=True) if not f]), (f"{name}.1", [v for v, f in zip(own, first, strict=True) if f])]
    return dict(sorted(out.items()))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def features(text: str) -> np.ndarray:
    """The unit feature vector of a whole text, taken in pieces of a million bytes."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)
    counts = np.zeros(DIM)
    for at in range(0, len(data), 1_000_000):
        part = _CLASS[data[at : at + 1_000_002]]
        two = part[:-1] * 73 + part[1:]
        counts[:DIM2] += np.bincount(two & (DIM2 - 1), minlength=DIM2)
        three = part[:-2] * 1973 + part[1:-1] * 503 + part[2:] * 43
        counts[DIM2:] += np.bincount((three ^ (three >> 7)) & (DIM3 - 1), minlength=DIM3)
    space = ord(" ")
    counts[(space * 73 + space) & (DIM2 - 1)] = 0  # runs of spaces say nothing
    triple = space * (1973 + 503 + 43)
    counts[DIM2 + ((triple ^ (triple >> 7)) & (DIM3 - 1))] = 0
    counts = np.sqrt(counts)
    return (counts / max(np.linalg.norm(counts), 1e-12)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, strength: float = 100.0, steps: int = 150) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss; y is -1 or 1, classes weigh the same.
    Accelerated gradient steps over all rows; nothing is random."""
    pull = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * strength
    rate = np.float32(1 / (1 + 2 * strength * 2))  # rows have a squared length of 2 with the bias
    w = v = np.zeros(x.shape[1] + 1, dtype=np.float32)
    for k in range(steps):
        push = pull * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * y
        new = v - rate * (v - 2 * np.append(push @ x, push.sum()).astype(np.float32))
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def fit_slope(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, with targets kept off 0 and 1."""
    p, n = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 2.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((q - goal) * margins).sum() + 1e-3 * a, (q - goal).sum()])
        s = q * (1 - q) + 1e-6
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-6:
            break
    return float(max(a, 0.1)), float(b)


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """The model: a matrix of all classifiers, and which column speaks for what."""
    lang = np.array(langs)
    families = families_of(x, langs)
    place = {v: f for f, own in families.items() for v in own}
    family = np.array([place[v] for v in langs])
    columns, slopes, parts = [], [], []

    def add(rows: np.ndarray, y: np.ndarray, what: tuple) -> None:
        own = x if len(rows) == len(x) else x[rows]
        w = fit_svm(own, y)
        columns.append(w)
        slopes.append(fit_slope(own @ w[:-1] + w[-1], y))
        parts.append(what)

    every = np.arange(len(x))
    if len(families) > 1:
        for f in families if len(families) > 2 else list(families)[:1]:
            add(every, np.where(family == f, 1.0, -1.0).astype(np.float32), ("family", f))
    for f, own in families.items():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                rows = np.flatnonzero((lang == a) | (lang == b))
                add(rows, np.where(lang[rows] == a, 1.0, -1.0).astype(np.float32), ("pair", f, a, b))
    weights = np.array(columns, dtype=np.float32).reshape(-1, DIM + 1)
    return {"families": families, "weights": weights, "slopes": slopes, "parts": parts}


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores of feature rows."""
    families, parts = list(model["families"]), model["parts"]
    margins = x @ model["weights"][:, :-1].T + model["weights"][:, -1] if parts else np.zeros((len(x), 0))
    prob = np.array([1 / (1 + np.exp(-np.clip(a * margins[:, k] + b, -30, 30))) for k, (a, b) in enumerate(model["slopes"])]).reshape(len(parts), len(x))
    fam = np.ones((len(families), len(x)))
    for k, part in enumerate(parts):
        if part[0] == "family":
            fam[families.index(part[1])] = prob[k]
            if len(families) == 2:
                fam[1 - families.index(part[1])] = 1 - prob[k]
    fam = fam / fam.sum(axis=0)
    chosen = fam.argmax(axis=0)
    langs = [""] * len(x)
    scores = fam.max(axis=0)
    for n, f in enumerate(families):
        rows = np.flatnonzero(chosen == n)
        own = model["families"][f]
        if not len(rows):
            continue
        votes, sure = np.zeros((len(own), len(rows))), np.zeros((len(own), len(rows)))
        for k, part in enumerate(parts):
            if part[:2] == ("pair", f):
                a, b = own.index(part[2]), own.index(part[3])
                p = prob[k][rows]
                votes[a] += p >= 0.5
                votes[b] += p < 0.5
                sure[a] += p
                sure[b] += 1 - p
        best = (votes * 1000 + sure).argmax(axis=0)
        for r, v in zip(rows.tolist(), best.tolist(), strict=True):
            langs[r] = own[v]
        if len(own) > 1:
            scores[rows] *= sure[best, np.arange(len(rows))] / (len(own) - 1)
    return langs, np.clip(scores, 0, 1)


def sample(docs: DataFrame) -> DataFrame:
    """(lang, text) to learn from: at most SAMPLE_PER_LANG rows a language and SAMPLE_ROWS in all, spread by a hash."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 <> 2")
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS).collect()]
    known = known.where(F.col("lang").isin(langs)) if langs else known.limit(0)
    bins = max(1, min(SAMPLE_PER_LANG, SAMPLE_ROWS // max(1, len(langs))))
    place, own = F.xxhash64(F.col("doc_id").cast("string")), F.xxhash64("text")
    # the least hashes of a bin, summed up before the shuffle: one row a language and bin
    picked = known.groupBy(F.col("lang").alias("p_lang"), F.pmod(place, F.lit(bins)).alias("bin")).agg(F.min(F.struct(place.alias("h"), own.alias("t"), "doc_id")).alias("first"))
    picked = F.broadcast(picked.select(F.col("first.doc_id").alias("p_id"), F.col("first.t").alias("p_text"), "p_lang"))  # at most SAMPLE_ROWS rows
    rows = known.withColumn("t", own).join(picked, F.expr("doc_id = p_id AND lang = p_lang AND t = p_text"), "left_semi")
    return rows.groupBy("lang", "doc_id", "t").agg(F.first("text").alias("text")).select("lang", "text")  # of repeated rows one


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(v, features(t).astype(np.float16).tobytes()) for v, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True) if has_letter(t)]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "x": pa.array([r[1] for r in rows], pa.binary())})


def _sampled(docs: DataFrame) -> tuple[np.ndarray, list[str]]:
    ship(docs.sparkSession)
    rows = sample(docs).mapInArrow(_featured, "lang string, x binary").collect()  # SAMPLE_ROWS vectors at most
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.empty((len(rows), DIM), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(r["x"], dtype=np.float16)
    return x, [r["lang"] for r in rows]


def learn(docs: DataFrame) -> dict | None:
    x, langs = _sampled(docs)
    return fit(x, langs) if langs else None


def learn_to_reject(docs: DataFrame) -> tuple[dict | None, float]:
    """(the model, the score below which a text is rejected)."""
    x, langs = _sampled(docs)
    if not langs:
        return None, 0.0
    lowest = 1.0
    for half in (0, 1):  # each half is scored by classifiers of the other
        own, rest = slice(half, None, 2), slice(1 - half, None, 2)
        if langs[own] and langs[rest]:
            lowest = min(lowest, float(predict(fit(np.ascontiguousarray(x[rest]), langs[rest]), np.ascontiguousarray(x[own]))[1].min()))
    return fit(x, langs), REJECT * lowest if len(langs) > 1 else 0.0


def _predictor(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            langs, scores = [UND] * batch.num_rows, np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows if model else 0, 256):
                some = [(at + k, t) for k, t in enumerate(texts.slice(at, 256).to_pylist()) if has_letter(t)]
                if some:
                    found, sure = predict(model, np.array([features(t) for _, t in some]))
                    for (k, _), v, s in zip(some, found, sure.tolist(), strict=True):
                        langs[k], scores[k] = v, s
            kept = {c: batch[c] for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(kept | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores)})

    return run


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    ship(docs.sparkSession)
    model = learn(docs) if model is None else model
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        _predictor(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    )


def keep_identified(docs: DataFrame, min_score: float | None = None) -> DataFrame:
    """docs whose language is found with at least that score (unset: the calibrated one). A row is kept or not by its own text."""
    model, bound = learn_to_reject(docs)
    bound = bound if min_score is None else min_score
    names = docs.columns
    verdict = _predictor(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                keep = np.array([has_letter(t) for t in batch["text"].to_pylist()], dtype=bool)
            else:
                (found,) = verdict([batch])
                keep = np.array([v != UND for v in found["lang_pred"].to_pylist()], dtype=bool) & (found["score"].to_numpy() >= bound)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
