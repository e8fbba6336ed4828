"""Source files that do not parse.

Method: for each language a recursive-descent parser of statements with precedence-climbing expressions. A fault inside a
statement is stored, and panic mode skips to where the next statement may begin, so that all faults of a file come out.
The first one, with the text around it, gives the cause (truncated, merge conflict, other language, binary content, open
string or comment, syntax).

Cases
* null text: no file to judge, no row. Empty C#, Python, JavaScript, YAML are valid, empty JSON is not.
* the language is ``language`` in any spelling, else the extension of ``path``; files of an unknown language and Markdown
  are accepted. Texts are read whole; beyond the nesting a parser follows (4,000 levels; flow collections of YAML have no
  bound), the faults before, the balance of brackets and Python's own parser decide. If they find none, the file is not
  judged: ``valid`` is null and the cause says so.
* repeated rows and later scans are judged each by itself. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.llm.syntax import first_cause, judged, language_of
from colligo.runtime import spread

_FAULTS = pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))


def check_syntax(files: DataFrame, only_invalid: bool = False) -> DataFrame:
    """``file_id, repo, language, valid, first_cause, faults`` of each file with a text, in one narrow pass."""
    kinds = {c: files.schema[c].dataType.simpleString() for c in ("file_id", "repo")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, languages, causes, valid, faults = [], [], [], [], []
            for k, (language, path, text) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())):
                named = language_of(language, path)
                found, whole = judged(text, named)
                if only_invalid and not found:
                    continue
                keep.append(k)
                languages.append(named)
                causes.append(first_cause(text, found, named or "") if whole else "not judged")
                valid.append(not found if whole else None)
                faults.append([{"line": f.line, "message": f.message} for f in found])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(languages, pa.string()), pa.array(valid, pa.bool_()), pa.array(causes, pa.string()), pa.array(faults, _FAULTS)],
                names=["file_id", "repo", "language", "valid", "first_cause", "faults"])

    texts = files.where(F.col("raw_text").isNotNull()).select("file_id", "repo", "language", "path", "raw_text")
    return spread(texts, files).mapInArrow(run, f"file_id {kinds['file_id']}, repo {kinds['repo']}, language string, valid boolean, first_cause string, faults array<struct<line:int,message:string>>")


def rates(checked: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid ones, those not judged, and acceptance among the others."""
    return checked.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("valid").isNull()).alias("not_judged_files"), F.count_if(~F.col("valid")).alias("invalid_files"), F.round(F.avg(F.col("valid").cast("double")), 6).alias("acceptance"))
