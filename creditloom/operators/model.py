"""Training, storing and applying the gradient-boosted default model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.functions.rules import risk_band
from creditloom.operators import boosting
from creditloom.operators.loans import balanced_weights, prepare_loans, stratified_split, synth_loans
from creditloom.operators.scoring import clamp_probability, dec
from creditloom.session import ensure_checkpoint_dir

ROUNDS, RATE, DEPTH, SEED = 200, 0.05, 6, 42
SYNTHETIC_LOANS = 1000


def train_default_model(loans: DataFrame, rounds: int = ROUNDS, label: str = "label") -> PipelineModel:
    """Boosted trees with balanced classes on the non-test rows of ``loans`` (key loan_id, features, label)."""
    ensure_checkpoint_dir(loans.sparkSession)
    split = stratified_split(prepare_loans(loans, label=label), label)
    # Classes are counted, rows sampled and then binned, so they are stored once instead of split again for each.
    train = balanced_weights(split.where(~F.col("is_test")).select(*fv.MODEL_FEATURES, label).checkpoint(), label)
    trees = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=rounds, stepSize=RATE,
                          maxDepth=DEPTH, seed=SEED, checkpointInterval=10)
    assembler = VectorAssembler(inputCols=fv.MODEL_FEATURES, outputCol="features")
    return PipelineModel(stages=[assembler, boosting.fit(train, fv.MODEL_FEATURES, trees)])


def holdout_predictions(model: PipelineModel, loans: DataFrame, label: str = "label") -> DataFrame:
    """Predictions for the test rows of the same split."""
    split = stratified_split(prepare_loans(loans, label=label), label)
    return model.transform(split.where("is_test"))


COMMITTED = "_committed"
_models: dict[tuple[str, str, int], PipelineModel] = {}


def _folder(spark: SparkSession, path: str):
    """A folder of any file system Spark can reach, and that file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _numbers(spark: SparkSession, path: str, committed: bool) -> list[int]:
    fs, root = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    numbers = [int(n.removeprefix("version-")) for n in names if n.startswith("version-")]
    return sorted(n for n in numbers if not committed or fs.exists(_folder(spark, f"{version_path(path, n)}/{COMMITTED}")[1]))


def version_path(path: str, number: int) -> str:
    """The folder of a version."""
    return f"{path}/version-{number:05d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete models of a store, ascending. A version whose writing was interrupted has no marker and does not count."""
    return _numbers(spark, path, True)


def save_version(model: PipelineModel, spark: SparkSession, path: str) -> int:
    """Writes a new version and then its marker. No file that exists is ever written again."""
    number = max(_numbers(spark, path, False), default=0) + 1
    model.save(version_path(path, number))
    fs, marker = _folder(spark, f"{version_path(path, number)}/{COMMITTED}")
    fs.create(marker, False).close()
    return number


def load_version(spark: SparkSession, path: str, number: int | None = None) -> PipelineModel:
    """A complete version, the newest by default; each is loaded once in an application. A damaged file raises."""
    known = versions(spark, path)
    number = known[-1] if number is None and known else number
    if number not in known:
        raise ValueError(f"{path} has no complete version {number if number is not None else ''}".rstrip())
    at = (spark.sparkContext.applicationId, path, number)
    if at not in _models:
        _models[at] = PipelineModel.load(version_path(path, number))
    return _models[at]


def load_or_train(spark: SparkSession, path: str, loans: DataFrame | None = None, rounds: int = ROUNDS) -> PipelineModel:
    """The newest model stored at ``path``; only where there is none a new one is trained and stored.

    Without loans the model is trained on synthetic ones.
    """
    if not versions(spark, path):
        data = loans if loans is not None else synth_loans(spark.range(SYNTHETIC_LOANS))
        save_version(train_default_model(data, rounds), spark, path)
    return load_version(spark, path)


def score_loans(features: DataFrame, model: PipelineModel, key: str = "loan_id") -> DataFrame:
    """Bounded default probability in percent, score and band for rows with all twelve features."""
    p = F.round((vector_to_array("probability")[1] * 100).cast("decimal(20,10)"), 2)
    return model.transform(features).select(
        key, clamp_probability(p, 80).cast("decimal(10,2)").alias("default_probability")
    ).select(
        key, F.col("default_probability").cast("double").alias("default_probability"),
        (F.lit(100) - F.col("default_probability")).cast("double").alias("ml_score"),
        risk_band(F.col("default_probability")).alias("recommendation"))


def with_fallback(companies: DataFrame, scores: DataFrame, key: str = "company_id") -> DataFrame:
    """Scores of all companies; those without one get the fixed values and factors."""
    def factors(values: dict[str, str]):
        return F.array(*[F.struct(F.lit(f).alias("feature"), dec(v, "decimal(10,4)").cast("double").alias("impact")) for f, v in values.items()])

    unscored = F.col("default_probability").isNull()
    return companies.select(key).join(scores, key, "left").select(
        key,
        F.coalesce(F.col("default_probability").cast("double"), F.lit(float(fv.UNSCORED["default_probability"]))).alias("default_probability"),
        F.coalesce(F.col("ml_score").cast("double"), F.lit(float(fv.UNSCORED["ml_score"]))).alias("ml_score"),
        F.when(unscored, fv.UNSCORED["recommendation"]).otherwise(F.col("recommendation")).alias("recommendation"),
        F.when(unscored, factors(fv.UNSCORED_RISKS)).alias("risk_factors"),
        F.when(unscored, factors(fv.UNSCORED_POSITIVES)).alias("positive_factors"))
