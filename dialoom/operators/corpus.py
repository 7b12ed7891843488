"""Raw records to lines, end to end, with a report of what was mended, dropped and changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Corpus
from ..errors import CorpusError
from .lines import build_lines, speaker_mappings
from .repair import build_rows, describe, fill_ids, load_report, not_empty, source_rows
from .speakers import case_map, label_counts, normalize_speakers


@dataclass(frozen=True)
class Parsed:
    lines: DataFrame
    #: Records that failed, rows without an episode, and rows without content.
    dead: DataFrame
    unresolved: DataFrame
    no_content: DataFrame
    #: (fact, n)
    report: DataFrame
    #: (speaker_raw, speaker, rules, n)
    mappings: DataFrame


def parse_corpus(records: DataFrame, scoped: DataFrame, everywhere: DataFrame, config: Corpus = Corpus()) -> Parsed:
    """Lines of raw records (csv_record and the string fields), with aliases as ``read_aliases`` has them.

    Rows that stay without season or episode are listed and left out; no lines at all is an error.
    """
    good, dead = build_rows(records)
    filled = fill_ids(not_empty(good))
    lost = F.col("filled") == "unresolved"
    rows = source_rows(filled.filter(~lost)).withColumnsRenamed({"speaker": "speaker_raw", "text": "text_raw"})
    names = normalize_speakers(rows, "csv_record", case_map(label_counts(rows)), scoped, everywhere)
    lines, empty = build_lines(rows, names, config.keep_label_on_first)
    if lines.isEmpty():
        raise CorpusError("the records have no lines")
    lines = lines.join(rows.select("csv_record", "speaker_raw"), "csv_record")
    unresolved = filled.filter(lost)
    count = lambda frame, name: frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fact"), "n")
    report = load_report(rows, dead, unresolved).unionByName(count(lines, "lines")).unionByName(count(empty, "no_content"))
    shown = empty.withColumnsRenamed({"speaker_raw": "speaker", "text_raw": "text"})
    return Parsed(lines, dead, describe(unresolved), describe(shown), report, speaker_mappings(lines))


def format_report(report: DataFrame) -> str:
    """The report (a row for each fact) as text."""
    facts = sorted((r["fact"], r["n"]) for r in report.collect())
    wide = max((len(f) for f, _ in facts), default=0)
    return "\n".join(f"{f:<{wide}}  {n}" for f, n in facts)
