"""A sample application: companies, shuttles and reviews are cleaned and joined, a price model is fitted, evaluated and
cross-validated, tables are checked against a reference table, and reports are made."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import reporting
from tessera.app import ApplicationBuilder
from tessera.app.config import in_range
from tessera.functions import is_true, parse_decimal, parse_int, parse_money, parse_percentage
from tessera.operators import models, tables
from tessera.plans import Constant, PassThrough, Pipeline, PipelineBuilder
from tessera.schema import column
from tessera.sources import BinaryObject, Catalog, CsvDataset, ExcelDataset, FileType, JsonDataset, JsonObject, MemoryDataset, MemoryObject, ParquetDataset, TextObject, entry
from tessera.validation import Level

SCORES = ("rating", "comfort", "amenities", "trip", "crew", "location", "price")
FEATURES = ("engines", "passenger_capacity", "crew", "d_check_complete", "iata_approved", "company_rating", "review_scores_rating")


@dataclass
class RawCompany:
    id: str
    company_rating: str | None
    company_location: str | None
    total_fleet_count: str | None
    iata_approved: str | None


@dataclass
class RawReview:
    shuttle_id: str
    review_scores_rating: str | None
    review_scores_comfort: str | None
    review_scores_amenities: str | None
    review_scores_trip: str | None
    review_scores_crew: str | None
    review_scores_location: str | None
    review_scores_price: str | None
    number_of_reviews: str | None
    reviews_per_month: str | None


@dataclass
class RawShuttle:
    id: str
    shuttle_location: str | None
    shuttle_type: str | None
    engine_type: str | None
    engine_vendor: str | None
    engines: str | None
    passenger_capacity: str | None
    cancellation_policy: str | None
    crew: str | None
    d_check_complete: str | None
    moon_clearance_complete: str | None
    price: str | None
    company_id: str | None


@dataclass
class Company:
    id: str
    company_rating: Decimal
    company_location: str
    total_fleet_count: Decimal
    iata_approved: bool


@dataclass
class Review:
    shuttle_id: str
    review_scores_rating: Decimal
    review_scores_comfort: Decimal
    review_scores_amenities: Decimal
    review_scores_trip: Decimal
    review_scores_crew: Decimal
    review_scores_location: Decimal
    review_scores_price: Decimal
    number_of_reviews: int = column(type="int")
    reviews_per_month: Decimal = column(type="decimal(38,18)")


@dataclass
class Shuttle:
    id: str
    shuttle_location: str
    shuttle_type: str
    engine_type: str
    engine_vendor: str
    engines: int = column(type="int")
    passenger_capacity: int = column(type="int")
    cancellation_policy: str = column()
    crew: int = column(type="int")
    d_check_complete: bool = column()
    moon_clearance_complete: bool = column()
    price: Decimal = column()
    company_id: str = column()


@dataclass
class ModelInput(Shuttle):
    review_scores_rating: Decimal = column()
    review_scores_comfort: Decimal = column()
    review_scores_amenities: Decimal = column()
    review_scores_trip: Decimal = column()
    review_scores_crew: Decimal = column()
    review_scores_location: Decimal = column()
    review_scores_price: Decimal = column()
    number_of_reviews: int = column(type="int")
    reviews_per_month: Decimal = column()
    company_rating: Decimal = column()
    company_location: str = column()
    total_fleet_count: Decimal = column()
    iata_approved: bool = column()


@dataclass
class Features:
    id: str
    engines: float = column(type="float")
    passenger_capacity: float = column(type="float")
    crew: float = column(type="float")
    d_check_complete: bool = column()
    iata_approved: bool = column()
    company_rating: float = column(type="float")
    review_scores_rating: float = column(type="float")
    price: Decimal = column()


@dataclass
class SplitParams:
    test_size: float = in_range(0, 1, 0.2)
    random_state: int = 3


@dataclass
class FoldParams:
    num_folds: int = in_range(2, 100, 3)
    base_seed: int = in_range(0, None, 42)
    reference_r2: float = in_range(0, 1, 0.462)


@dataclass
class ScienceParams:
    split: SplitParams = field(default_factory=SplitParams)
    folds: FoldParams = field(default_factory=FoldParams)


def clean_companies(raw: DataFrame) -> DataFrame:
    parsed = raw.select(
        "id", parse_percentage(F.col("company_rating")).alias("company_rating"), "company_location",
        parse_decimal(F.col("total_fleet_count")).alias("total_fleet_count"), is_true(F.col("iata_approved")).alias("iata_approved"),
    )
    return tables.drop_incomplete(parsed, ["company_rating", "total_fleet_count"], ["company_location"])


def clean_reviews(raw: DataFrame) -> DataFrame:
    scores = [f"review_scores_{s}" for s in SCORES]
    parsed = raw.select(
        "shuttle_id", *(parse_decimal(F.col(c)).alias(c) for c in scores), parse_int(F.col("number_of_reviews")).alias("number_of_reviews"),
        parse_decimal(F.col("reviews_per_month")).alias("reviews_per_month"),
    )
    return tables.drop_incomplete(parsed, [*scores, "number_of_reviews", "reviews_per_month"], ["shuttle_id"])


def clean_shuttles(raw: DataFrame) -> DataFrame:
    numbers, flags = ("engines", "passenger_capacity", "crew"), ("d_check_complete", "moon_clearance_complete")
    parsed = raw.withColumns(
        {c: parse_int(F.col(c)) for c in numbers} | {c: is_true(F.col(c)) for c in flags} | {"price": parse_money(F.col("price"))}
    )
    return tables.drop_incomplete(parsed, numbers, ["shuttle_location", "shuttle_type", "engine_type", "engine_vendor", "cancellation_policy"])


def join_model_input(shuttles: DataFrame, companies: DataFrame, reviews: DataFrame) -> DataFrame:
    joined = tables.chain_join(reviews, (shuttles, "shuttle_id", "id"), (companies.withColumnRenamed("id", "own_id"), "company_id", "own_id"))
    return joined.drop("shuttle_id", "own_id")


def split_data(model_input: DataFrame, params: SplitParams) -> dict[str, DataFrame]:
    floats = ("engines", "passenger_capacity", "crew", "company_rating", "review_scores_rating")
    row = F.concat_ws("|", "id", F.col("reviews_per_month").cast("string")).alias("row")
    rows = model_input.select("id", *(F.col(c).cast("float").alias(c) for c in floats), "d_check_complete", "iata_approved", "price", row)
    marked = tables.split(rows, "row", params.test_size, params.random_state)
    order = ["id", "engines", "passenger_capacity", "crew", "d_check_complete", "iata_approved", "company_rating", "review_scores_rating", "price"]
    return {"train": marked.where(~F.col("is_test")).select(order), "test": marked.where("is_test").select(order)}


def _numeric(frame: DataFrame) -> DataFrame:
    return frame.select(*(F.col(c).cast("double").alias(c) for c in (*FEATURES, "price")))


def train_model(train: DataFrame) -> models.LinearModel:
    return models.least_squares(_numeric(train), FEATURES, "price")


def evaluate_model(regressor: models.LinearModel, test: DataFrame) -> dict:
    return models.evaluate(_numeric(test), regressor, "price").first().asDict()


def cross_validate(model_input: DataFrame, params: FoldParams) -> dict:
    rows = model_input.select(F.concat_ws("|", "id", F.col("reviews_per_month").cast("string")).alias("row"), *(F.col(c).cast("double").alias(c) for c in (*FEATURES, "price")))
    folds = models.cross_validate(rows, "row", FEATURES, "price", params.num_folds, params.base_seed)
    return models.summarize_folds(folds, params.reference_r2).first().asDict(recursive=True)


@dataclass
class Difference:
    key: str
    found: str
    fields: str


#: The fields that the check against the reference compares: numbers within the tolerance, the others exactly.
COMPARED_NUMBERS = ("engines", "passenger_capacity", "crew", "price", "company_rating", "review_scores_rating")
COMPARED_EXACTLY = ("shuttle_type", "d_check_complete", "moon_clearance_complete", "company_id", "company_location", "iata_approved")


def check_reference(model_input: DataFrame, reference: DataFrame) -> DataFrame:
    """All differences by shuttle and month rate: for rows of both tables the names of the fields that differ, and the keys
    that only one table has. Raises if a key occurs more than once in a table."""
    rate = F.coalesce(F.col("reviews_per_month").cast("double").cast("string"), F.lit(""))
    left, right = (f.withColumn("key", F.concat(F.coalesce("id", F.lit("")), F.lit("|"), rate)) for f in (model_input, reference))
    found = tables.reconcile(left, right, "key", COMPARED_NUMBERS, COMPARED_EXACTLY)
    fields = F.concat_ws(", ", *(F.when(~F.col(f"{c}_ok"), F.lit(c)) for c in (*COMPARED_NUMBERS, *COMPARED_EXACTLY)))
    both = found.where(~F.col("all_ok")).select("key", F.lit("both").alias("found"), fields.alias("fields"))
    only = [
        tables.keys_in_left_only(a.select("key"), b.select("key")).select("key", F.lit(where).alias("found"), F.lit("").alias("fields"))
        for a, b, where in ((left, right, "model input only"), (right, left, "reference only"))
    ]
    return both.union(only[0]).union(only[1])


def capacity_chart(shuttles: DataFrame) -> dict:
    means = tables.average_by(shuttles, "shuttle_type", "passenger_capacity", "average_capacity")
    return reporting.column_chart(means, "shuttle_type", "average_capacity", "Average passenger capacity")


#: The sample's fixed labels: actual and predicted classes.
ACTUAL, PREDICTED = (0, 1, 0, 0, 1, 0, 1, 0, 1, 1), (1, 1, 0, 1, 0, 1, 0, 0, 1, 1)


def confusion_chart(companies: DataFrame) -> dict:
    spark = companies.sparkSession
    pairs = spark.createDataFrame(list(zip(ACTUAL, PREDICTED, strict=True)), "actual int, predicted int")
    rows = models.confusion_matrix(pairs, "actual", "predicted").orderBy("actual").collect()
    return reporting.heat_map([[r["predicted_0"], r["predicted_1"]] for r in rows], ["0", "1"], ["0", "1"], "Confusion matrix")


def folds_chart(results: dict) -> dict:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    mean, deviation = results["mean_r2_score"], results["std_dev_r2_score"] or 1e-9
    curve = models.normal_curve(spark, mean, deviation, 101)
    points = [(f["r2_score"], 0.0) for f in results["fold_metrics"]]
    return reporting.curve_chart(curve, points, [("mean", mean), ("reference", results["reference_r2_score"])], "R² of the folds")


class FleetCatalog(Catalog):
    """Raw files, cleaned tables, models and reports below one folder."""

    @entry
    def companies_raw(self):
        return CsvDataset("RawCompanies", RawCompany, self.path("raw", "companies.csv")).with_inspection_level(Level.DEEP)

    @entry
    def reviews_raw(self):
        return CsvDataset("RawReviews", RawReview, self.path("raw", "reviews.csv")).with_inspection_level(Level.DEEP)

    @entry
    def shuttles_raw(self):
        return ExcelDataset("RawShuttles", RawShuttle, self.path("raw", "shuttles.xlsx")).with_inspection_level(Level.DEEP)

    @entry
    def reference(self):
        return CsvDataset("ReferenceModelInput", ModelInput, self.path("reference", "model_input.csv"))

    @entry
    def reference_differences(self):
        return CsvDataset("ReferenceDifferences", Difference, self.path("diagnostics", "reference_differences.csv"))

    @entry
    def companies(self):
        return ParquetDataset("CleanedCompanies", Company, self.path("clean", "companies.parquet"))

    @entry
    def reviews(self):
        return ParquetDataset("CleanedReviews", Review, self.path("clean", "reviews.parquet"))

    @entry
    def shuttles(self):
        return ParquetDataset("CleanedShuttles", Shuttle, self.path("clean", "shuttles.parquet"))

    @entry
    def model_input(self):
        return ParquetDataset("ModelInputTable", ModelInput, self.path("clean", "model_input.parquet"))

    @entry
    def companies_csv(self):
        return CsvDataset("CleanedCompaniesCsv", Company, self.path("diagnostics", "companies.csv"))

    @entry
    def shuttles_csv(self):
        return CsvDataset("CleanedShuttlesCsv", Shuttle, self.path("diagnostics", "shuttles.csv"))

    @entry
    def model_input_csv(self):
        return CsvDataset("ModelInputTableCsv", ModelInput, self.path("diagnostics", "model_input.csv"))

    @entry
    def model_input_json(self):
        return JsonDataset("ModelInputTableJsonMinified", ModelInput, self.path("diagnostics", "model_input.json"), minified=True)

    @entry
    def train(self):
        return MemoryDataset("Train", Features)

    @entry
    def test(self):
        return MemoryDataset("Test", Features)

    @entry
    def regressor(self):
        return MemoryObject("Regressor", models.LinearModel)

    @entry
    def metrics(self):
        return JsonObject("ModelMetrics", self.path("models", "metrics.json"))

    @entry
    def folds(self):
        return JsonObject("CrossValidationResults", self.path("models", "folds.json"))

    @entry
    def folds_held(self):
        return MemoryObject("CrossValidationHeld", dict)

    @entry
    def capacity(self):
        return MemoryObject("CapacityChart", dict)

    @entry
    def confusion(self):
        return MemoryObject("ConfusionChart", dict)

    @entry
    def folds_plot(self):
        return MemoryObject("CrossValidationChart", dict)

    def plot(self, name: str):
        return self._port(f"{name}Plot", lambda: TextObject(f"{name}Plot", self.path("reports", f"{name}.json")))

    def image(self, name: str):
        return self._port(f"{name}Png", lambda: BinaryObject(f"{name}Png", self.path("reports", f"{name}.png"), FileType.PNG))

    def _port(self, key: str, make):  # noqa: ANN001
        with self._lock:
            return self._made.setdefault(key, make()) if key not in self._made else self._made[key]

    @entry
    def report(self):
        return TextObject("CrossValidationReport", self.path("reports", "cross_validation.md"))


def data_processing(c: FleetCatalog) -> Pipeline:
    return (
        PipelineBuilder("DataProcessing")
        .add_node(clean_companies, c.companies_raw, c.companies, "PreprocessCompanies")
        .add_node(clean_shuttles, c.shuttles_raw, c.shuttles, "PreprocessShuttles")
        .add_node(clean_reviews, c.reviews_raw, c.reviews, "PreprocessReviews")
        .add_node(join_model_input, {"shuttles": c.shuttles, "companies": c.companies, "reviews": c.reviews}, c.model_input, "CreateModelInputTable")
        .build()
    )


def data_science(c: FleetCatalog, params: ScienceParams) -> Pipeline:
    return (
        PipelineBuilder("DataScience")
        .add_node(split_data, {"model_input": c.model_input, "params": Constant(params.split)}, {"train": c.train, "test": c.test}, "SplitData")
        .add_node(train_model, c.train, c.regressor, "TrainModel")
        .add_node(evaluate_model, {"regressor": c.regressor, "test": c.test}, c.metrics, "EvaluateModel")
        .add_node(cross_validate, {"model_input": c.model_input, "params": Constant(params.folds)}, c.folds_held, "CrossValidate")
        .add_node(PassThrough(), c.folds_held, c.folds, "SaveCrossValidation")
        .build()
    )


def data_validation(c: FleetCatalog) -> Pipeline:
    return (
        PipelineBuilder("DataValidation")
        .add_node(check_reference, {"model_input": c.model_input, "reference": c.reference}, c.reference_differences, "CheckAgainstReference")
        .add_node(PassThrough(), c.companies, c.companies_csv, "ExportCompaniesCsv")
        .add_node(PassThrough(), c.shuttles, c.shuttles_csv, "ExportShuttlesCsv")
        .add_node(PassThrough(), c.model_input, c.model_input_csv, "ExportModelInputCsv")
        .add_node(PassThrough(), c.model_input, c.model_input_json, "ExportModelInputJson")
        .build()
    )


def reporting_pipeline(c: FleetCatalog) -> Pipeline:
    made = (
        PipelineBuilder("Reporting")
        .add_node(capacity_chart, c.shuttles, c.capacity, "CapacityChart")
        .add_node(confusion_chart, c.companies, c.confusion, "ConfusionChart")
        .add_node(folds_chart, c.folds_held, c.folds_plot, "CrossValidationChart")
        .add_node(reporting.cross_validation_report, c.folds_held, c.report, "CrossValidationReport")
    )
    for name, chart in (("Capacity", c.capacity), ("Confusion", c.confusion), ("CrossValidation", c.folds_plot)):
        made.add_node(lambda chart: reporting.chart_json(chart), chart, c.plot(name), f"Export{name}Json")
        made.add_node(lambda chart: reporting.chart_png(chart), chart, c.image(name), f"Export{name}Png")
    return made.build()


def configure(app: ApplicationBuilder, base_path: str, params: ScienceParams | None = None) -> None:
    """Registers the sample's pipelines over a folder."""
    app.use_catalog(FleetCatalog(base_path))
    app.register("DataProcessing", data_processing).with_description("Cleans and joins the raw tables.").with_tags("etl")
    app.register("DataScience", data_science, params or ScienceParams())
    app.register("DataValidation", data_validation)
    app.register("Reporting", reporting_pipeline)
