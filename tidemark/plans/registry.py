"""Registry of named views: dependencies, build order, temp views and the sanity sweep."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import StudyConfig
from tidemark.operators.calendar import calendar_range
from tidemark.operators.series import align
from tidemark.session import run_dir
from tidemark.sources import quality, readers, schemas, typed


@dataclass(frozen=True)
class View:
    name: str
    requires: tuple[str, ...]
    build: Callable[[Study], DataFrame]


VIEWS: dict[str, View] = {}


def view(name: str, *requires: str):
    """Register a builder under ``name``; ``requires`` lists the tables and views it reads."""

    def register(build: Callable[[Study], DataFrame]):
        VIEWS[name] = View(name, requires, build)
        return build

    return register


def build_order(views: Mapping[str, View] | None = None) -> list[str]:
    """View names, each after everything it requires."""
    views = VIEWS if views is None else views
    done: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in done or name not in views:
            return
        if name in path:
            raise ValueError(f"view cycle: {' -> '.join((*path, name))}")
        for required in views[name].requires:
            visit(required, (*path, name))
        done.append(name)

    for name in views:
        visit(name, ())
    return done


class Study:
    """Tables, parameters and views of one study. Frames are built lazily and once."""

    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
        cfg: StudyConfig | None = None,
    ):
        self.spark = spark
        self.cfg = cfg or StudyConfig()
        self.sources = dict(tables)
        self._built: dict[str, DataFrame] = {}
        self._pinned: dict[str, DataFrame] = {}
        self._window: tuple[date, date] | None = None

    @staticmethod
    def _typed(name: str, frame: DataFrame) -> DataFrame:
        if name == "gdelt" and "globaleventid" in frame.columns:
            return typed.typed_events(frame)
        if name == "gdelt_gkg" and "gkgrecordid" in frame.columns:
            return typed.typed_articles(frame)
        return frame

    @classmethod
    def from_files(
        cls, spark: SparkSession, root: str, cfg: StudyConfig | None = None
    ) -> Study:
        """Load the landed files below ``root``; a source without files is left out."""
        tables: dict[str, DataFrame] = {}
        for name, schema in schemas.HEADED_TABLES.items():
            path = f"{root}/{name}.csv"
            if readers.optional_source(spark, path):
                tables[name] = readers.headed_csv(spark, path, schema)
        if readers.optional_source(spark, f"{root}/gdelt", "*.export.CSV"):
            tables["gdelt"] = readers.events_tsv(spark, f"{root}/gdelt")
        if readers.optional_source(spark, f"{root}/gdelt_gkg", "*.gkg.csv"):
            tables["gdelt_gkg"] = readers.articles_tsv(spark, f"{root}/gdelt_gkg")
        return cls(spark, tables, cfg)

    def get(self, name: str) -> DataFrame:
        """A table or view by name."""
        if name in self._built:
            return self._built[name]
        if name in self.sources:
            source = self.sources[name]
            self._built[name] = self._typed(name, source() if callable(source) else source)
        else:
            if name not in VIEWS:
                raise KeyError(f"no table or view {name!r}")
            missing = self.missing(name)
            if missing:
                raise KeyError(f"{name} needs {', '.join(missing)}")
            self._built[name] = VIEWS[name].build(self)
        return self._built[name]

    def missing(self, name: str) -> list[str]:
        """Tables a view needs, directly or through other views, that are not there."""
        if name in self.sources:
            return []
        if name not in VIEWS:
            return [name]
        out: list[str] = []
        for required in VIEWS[name].requires:
            out += [m for m in self.missing(required) if m not in out]
        return out

    def pin(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Write a calendar-sized frame once and read it back, so that steps which pass over it
        several times do not repeat the scans behind it.

        The copy lies in the session's shared checkpoint folder: it survives lost executors
        and its file size lets Spark choose join strategies.
        """
        if name not in self._pinned:
            frame = build()
            path = run_dir(self.spark, name)
            frame.write.parquet(path)
            self._pinned[name] = self.spark.read.schema(frame.schema).parquet(path)
        return self._pinned[name]

    def release(self) -> None:
        """Delete the pinned copies; frames built on them can no longer run."""
        conf = self.spark._jsc.hadoopConfiguration()
        for frame in self._pinned.values():
            for file in frame.inputFiles()[:1]:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
                folder.getFileSystem(conf).delete(folder, True)
        self._pinned.clear()

    def panel(self, *series: str) -> DataFrame:
        """The named daily series side by side, keyed ``price_date`` (see ``align``)."""
        return align({name: self.get(SERIES_VIEWS[name]) for name in series}, "price_date")

    def series_window(self) -> tuple[date, date]:
        """Day range of the trading grid, early enough for every horizon to end before it."""
        if self._window is None:
            first, last = self.cfg.series_start, self.cfg.series_end
            if first is None or last is None:
                found = calendar_range(self.get("v_brent_daily"), "price_date")
                first, last = first or found[0], last or found[1]
            self._window = (first - timedelta(days=max((3, *self.cfg.horizons))), last)
        return self._window

    def available(self) -> list[str]:
        return [name for name in build_order() if not self.missing(name)]

    def create_views(self) -> list[str]:
        """Register every table and buildable view as a temp view; the skipped ones return."""
        for name in (*self.sources, *self.available()):
            self.get(name).createOrReplaceTempView(name)
        return [name for name in build_order() if self.missing(name)]

    def sweep(self) -> DataFrame:
        """Row count of every table and view, flagged when empty.

        Objects that cannot be built, as a table is absent or their definition fails, have a
        row without count and flag instead of ending the sweep.
        """
        absent = {m: None for n in build_order() for m in self.missing(n)}
        good, failed = {}, [*absent, *(n for n in build_order() if self.missing(n))]
        for name in (*self.sources, *self.available()):
            try:
                good[name] = self.get(name)
                good[name].schema  # noqa: B018  analysis happens here
            except Exception as why:  # noqa: BLE001  any failure of one object is its own
                logging.getLogger(__name__).warning("%s cannot be built: %s", name, why)
                good.pop(name, None)
                failed.append(name)
        parts = [quality.row_counts(good)] if good else []
        if failed:
            schema = "object string, n_rows long, is_empty boolean"
            parts.append(self.spark.createDataFrame([(n, None, None) for n in failed], schema))
        return reduce(DataFrame.unionByName, parts)

    def columns(self) -> list[tuple[str, str, str]]:
        """(object, column, type) of everything available; schemas only, no job runs."""
        names = [*self.sources, *self.available()]
        return [
            (name, f.name, f.dataType.simpleString())
            for name in names
            for f in self.get(name).schema.fields
        ]


SERIES_VIEWS = {
    "brent": "v_brent_daily",
    "ttf": "v_ttf_daily",
    "power": "v_gb_power_daily",
    "mix": "v_gb_gen_mix_daily",
    "carbon": "v_uka_proxy_daily",
}
