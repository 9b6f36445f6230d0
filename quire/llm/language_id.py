"""Language ID by interpolated Kneser-Ney character models, one a language.

The language whose model has the lowest cross-entropy per character is chosen.
A text is *rejected* if even that is higher than held-out texts of its length have
it in any language (so that a text that mixes languages is not): the limits are
calibrated on a second sample, never on the texts that are judged.

The models learn from a bounded sample of labelled texts (``per_language`` texts
of each label that occurs, the first ``longest`` characters of each, by the hash
of id and text; texts of under ``SHORT`` characters only where a label has no
longer ones).  Each label's model is learned on a worker.  Models that are too many
for a worker's memory go to the workers in blocks, a pass over the texts for each.
Texts that are judged are read whole.

Nulls: a text that is null or has no letter is ``und`` and rejected; a row whose
label is null teaches nothing; a null id counts as an empty one.  Of languages with
equal cross-entropies the first by name is chosen.  With nothing to learn from,
every text is ``und``.  A column of the input that has an output's name gives way.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from .charlm import CharModel, kneser_ney, log_probabilities

ORDER = 4
PER_LANGUAGE = 400
LONGEST = 20_000
SHORT = 20
FEW = 100_000  #: labels whose counts are broadcast
BLOCK_BYTES = 128 << 20  #: of models that a worker holds at once
MARGIN = 1.0  #: the least that a limit lies above the middle of held-out texts, in nats a character
UNKNOWN = "und"


class LanguageModel:
    """names and limits of all languages; ``blocks`` cuts the names into consecutive blocks, ``load`` fetches the models of one."""

    def __init__(self, names: list[str], limits: list[tuple[float, float, float]], blocks: list[tuple[int, int]], load):
        self.names, self.limits, self.blocks, self.load = names, limits, blocks, load


def compare(names: list[str], models: list[CharModel], texts: list[str | None], before=None):
    """(language, its cross-entropy, sum of the languages' odds against it, has the text letters, characters) of each text, ``before``: of the languages that were compared before (the first three)."""
    clean = [(t or "").lower() for t in texts]
    some = np.array([any(map(str.isalpha, t[:200])) or any(map(str.isalpha, t)) for t in clean], bool)
    total, size = log_probabilities(models, [t if s else "" for t, s in zip(clean, some)])
    if not models:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), some, size
    cross = -total / np.maximum(size, 1)[:, None]
    best = cross.argmin(axis=1)
    low = cross[np.arange(len(best)), best]
    reach = np.minimum(size, 100)
    odds = np.exp(-(cross - low[:, None]) * reach[:, None]).sum(axis=1)
    pred = [names[b] if s else UNKNOWN for b, s in zip(best, some)]
    if before is not None:
        least = np.minimum(low, before[1])
        odds = odds * np.exp(-(low - least) * reach) + before[2] * np.exp(-(before[1] - least) * reach)
        pred = [new if x < y else old for new, old, x, y in zip(pred, before[0], low, before[1])]
        low = least
    return pred, low, odds, some, size


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> LanguageModel:
    rows = labelled.select(F.col(id_col).cast("string").alias("i"), F.substring(F.col(text_col).cast("string"), 1, longest).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t <> '' and l is not null")
    rows = rows.withColumn("d", F.pmod(F.xxhash64(F.coalesce("i", F.lit("")), "t", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)).withColumn("long", F.length("t") >= SHORT)
    # a row per label: whether it has texts that are not short, how many, and the least hash of those
    number = rows.groupBy("l", "long").agg(F.count("*").alias("n"), F.min("d").alias("least")).groupBy("l").agg(F.max(F.struct("long", "n", "least")).alias("k")).select("l", "k.*")
    number = X.checkpoint(number)
    few = number.limit(FEW + 1).count() <= FEW
    share = rows.join(F.broadcast(number) if few else number, ["l", "long"]).where((F.col("d") < F.lit(2 * per_language) / F.col("n")) | (F.col("d") <= F.col("least")))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(i=pdf["i"].fillna("")).sort_values(["d", "i", "t"])[: 2 * per_language]
        texts = [t.lower() for t in pdf["t"]]
        model = kneser_ney(texts[: (len(texts) + 1) // 2], ORDER)
        # held-out texts: their usual cross-entropy, its spread, and what shortness adds
        total, size = log_probabilities([model], texts[(len(texts) + 1) // 2 :] or texts)
        cross = -total[:, 0] / np.maximum(size, 1)
        middle = float(np.median(cross))
        data = pickle.dumps(model)
        return pd.DataFrame({"l": pdf["l"].iloc[:1].tolist(), "size": [len(data)], "middle": [middle], "spread": [max(float(cross.max()) - middle, 6 * float(np.std(cross)), MARGIN)], "data": [data]})

    learned = X.checkpoint(share.select("l", "d", "i", "t").distinct().groupBy("l").applyInPandas(learn, "l string, size long, middle double, spread double, data binary"))
    known = sorted(learned.select("l", "size", "middle", "spread").collect(), key=lambda r: r["l"])
    names = [r["l"] for r in known]
    blocks, begin, held = [], 0, 0
    for k, r in enumerate(known):
        if k > begin and held + r["size"] > block_bytes:
            blocks.append((begin, k))
            begin, held = k, 0
        held += r["size"]
    blocks.append((begin, len(known)))

    def load(block: tuple[int, int]) -> list[CharModel]:
        own = names[block[0] : block[1]]
        if not own:
            return []
        got = learned.where(F.col("l").between(own[0], own[-1])).select("l", "data").collect()
        data = {r["l"]: r["data"] for r in got}
        return [pickle.loads(data[n]) for n in own]

    return LanguageModel(names, [(r["middle"], r["spread"], 8 * math.log(2)) for r in known], blocks, load)


def classify(df: DataFrame, model: LanguageModel, text_col: str, out: str = "lang_") -> DataFrame:
    """All columns, and ``out`` + pred, score, cross_entropy, rejected. A block of models goes to every worker once."""
    fields = df.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    at = [f.name for f in fields].index(text_col)
    inner = df.toDF(*names)
    own = [T.StructField(n, f.dataType, True) for n, f in zip(names, inner.schema.fields)]
    state = [T.StructField("pred", T.StringType()), T.StructField("cross", T.DoubleType()), T.StructField("odds", T.DoubleType())]
    more = [T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    limit = max((middle + spread for middle, spread, _ in model.limits), default=0.0)
    short = max((x for _, _, x in model.limits), default=0.0)
    nothing = not model.names

    def step(shared, first: bool, last: bool):
        def run(batches):
            for whole in batches:
                for b in X.slices(whole, names[at]):
                    before = None if first else (b.column("pred").to_pylist(), b.column("cross").to_numpy(), b.column("odds").to_numpy())
                    pred, low, odds, some, size = compare(*shared.value, b.column(names[at]).to_pylist(), before)
                    kept = {n: b.column(n) for n in names} | {"pred": pa.array(pred, pa.string())}
                    if not last:
                        yield pa.RecordBatch.from_pydict(kept | {"cross": pa.array(low, pa.float64()), "odds": pa.array(odds, pa.float64())})
                        continue
                    score = np.where(some, 1 / np.maximum(odds, 1e-300), 0.0) if not nothing else np.zeros(len(pred))
                    rejected = ~some | (low > limit + short / np.sqrt(np.maximum(size, 1))) | nothing
                    yield pa.RecordBatch.from_pydict(kept | {"score": pa.array(score, pa.float64()), "cross": pa.array(low, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

        return run

    for k, block in enumerate(model.blocks):
        shared = df.sparkSession.sparkContext.broadcast((model.names[block[0] : block[1]], model.load(block)))
        last = k == len(model.blocks) - 1
        inner = X.arrow(inner).mapInArrow(step(shared, k == 0, last), T.StructType(own + (more if last else state)))
        if not last:  # so that the next block's workers don't hold this one's models too
            inner = X.checkpoint(inner)
    return X.named(inner, names, fields, [f.name for f in more], [f"{out}pred", f"{out}score", f"{out}cross_entropy", f"{out}rejected"])


def fold(id_col: str, of: int):
    """crc32 of the id as text, modulo ``of``; of a null id 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % of


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.read(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 4) != 2), "doc_id", "text", "lang")
    found = classify(docs.select("doc_id", "text"), model, "text")
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("lang_pred"), F.col("lang_score").alias("score"), F.col("lang_cross_entropy").alias("cross_entropy"), F.col("lang_rejected").alias("rejected"))
