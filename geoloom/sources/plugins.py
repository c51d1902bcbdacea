"""An index of plugin archives: the metadata file of each zip below a folder."""

from __future__ import annotations

import configparser
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def index(spark: SparkSession, folder: str) -> DataFrame:
    """file, name, metadata (map) of each zip with a metadata.txt; others are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")

    def run(batches):
        for b in batches:
            rows = []
            for path, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(blob)) as z:
                        name = next((n for n in z.namelist() if n.count("/") <= 1 and n.rsplit("/", 1)[-1] == "metadata.txt"), None)
                        if name is None:
                            continue
                        ini = configparser.ConfigParser(interpolation=None, strict=False)
                        ini.read_string(z.read(name).decode("utf-8", "replace"))
                        values = dict(ini["general"]) if "general" in ini else {}
                except (zipfile.BadZipFile, configparser.Error):
                    continue
                rows.append((path.rsplit("/", 1)[-1], values.get("name"), list(values.items())))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.map_(pa.string(), pa.string()))], ["file", "name", "metadata"])

    return files.mapInArrow(run, "file string, name string, metadata map<string,string>")
