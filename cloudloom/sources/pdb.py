"""C-alpha atoms of structure files, parsed with column expressions.

Lines end at \\n or \\r\\n. All atoms named CA are kept: alternate locations, models and calcium ions too, unless
``atoms_only`` leaves out HETATM lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First column and width of the fields of an atom line.
FIELDS = {
    "atom_serial": (7, 5),
    "residue_name": (18, 3),
    "chain_id": (22, 1),
    "residue_number": (23, 4),
    "insertion_code": (27, 1),
    "x": (31, 8),
    "y": (39, 8),
    "z": (47, 8),
    "b_factor": (61, 6),
}
COLUMNS = ["protein_id", "residue_index", *FIELDS]


def structure_files(spark: SparkSession, folder: str, pattern: str = "*.pdb") -> DataFrame:
    """(path, value): whole files, read in parallel; no file raises FileNotFoundError."""
    df = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), "value")
    if df.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return df


def lines(files: DataFrame) -> DataFrame:
    """(protein_id, line_number, line) of files (path, value); the id is the file name without its ending."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(F.url_decode(stem).alias("protein_id"), F.posexplode(F.split("value", "\r?\n")).alias("line_number", "line"))


def _field(name: str) -> Column:
    at, width = FIELDS[name]
    return F.substring("line", at, width)


def hybrid36(number: Column, width: int) -> Column:
    """Serial and residue numbers as text of their column's width: decimal while that is wide enough, then base 36 with a
    first letter in upper case, then in lower case, as hybrid-36 has it; beyond that an error."""
    ten, letters = 10**width, 26 * 36 ** (width - 1)
    base = lambda n: F.conv((n - ten + 10 * 36 ** (width - 1)).cast("string"), 10, 36)
    n = number.cast("long")
    text = F.when(n < ten, F.lpad(n.cast("string"), width, " ")).when(n < ten + letters, F.upper(base(n))).when(n < ten + 2 * letters, F.lower(base(n - letters)))
    return F.when((n > -(ten // 10)) & (n < ten + 2 * letters), text).when(n.isNotNull(), F.raise_error(F.concat(F.lit("too large for its column: "), n.cast("string"))))


def _whole_number(name: str) -> Column:
    """A number of hybrid36(), or null."""
    width, text = FIELDS[name][1], _field(name)
    digits = F.conv(text, 36, 10).cast("long")
    upper = text.rlike(f"^[A-Z][0-9A-Z]{{{width - 1}}}$")
    lower = text.rlike(f"^[a-z][0-9a-z]{{{width - 1}}}$")
    n = F.when(upper, digits - 10 * 36 ** (width - 1) + 10**width).when(lower, digits + 16 * 36 ** (width - 1) + 10**width)
    return F.coalesce(n.cast("int"), F.trim(text).try_cast("int"))


def parse_atoms(atom_lines: DataFrame, malformed: str = "fallback", atoms_only: bool = False, index_base: int = 1) -> DataFrame:
    """Residues of (protein_id, line_number, line).

    malformed: ``fallback`` reads lines whose fixed columns do not parse by white space (at least 11 tokens, else an
    error), ``strict`` raises, ``skip`` leaves them out. Structures without an atom have no row; require_atoms() raises.
    """
    if malformed not in ("fallback", "strict", "skip"):
        raise ValueError(f"unknown rule {malformed!r}")
    line = F.col("line")
    record = line.startswith("ATOM") if atoms_only else line.startswith("ATOM") | line.startswith("HETATM")
    wanted = record & (F.trim(F.substring("line", 13, 4)) == "CA")
    ca = atom_lines.where(wanted)
    number = lambda n, kind: F.trim(_field(n)).try_cast(kind)
    fixed = F.struct(
        _whole_number("atom_serial").alias("atom_serial"),
        F.coalesce(F.nullif(F.trim(_field("residue_name")), F.lit("")), F.lit("UNK")).alias("residue_name"),
        F.coalesce(F.nullif(F.trim(_field("chain_id")), F.lit("")), F.lit("_")).alias("chain_id"),
        _whole_number("residue_number").alias("residue_number"),
        F.trim(_field("insertion_code")).alias("insertion_code"),
        *[number(n, "double").alias(n) for n in ("x", "y", "z", "b_factor")],
    )
    numeric = [n for n in FIELDS if n not in ("residue_name", "chain_id", "insertion_code")]
    ca = ca.withColumn("f", fixed)
    good = ~F.exists(F.array(*[F.col("f")[n].isNull() for n in numeric]), lambda x: x)
    # the error is raised under the same condition as the filter, which the optimizer may evaluate later
    if malformed == "skip":
        ca = ca.where(good)
    elif malformed == "strict":
        ca = ca.withColumn("f", F.when(good, F.col("f")).when(wanted, F.raise_error(F.concat(F.lit("malformed atom line: "), line))))
    else:
        ca = ca.withColumn("f", F.when(good, F.col("f")).when(wanted, _by_tokens(line)))
    position = F.row_number().over(_in_file()) - 1 + index_base
    return ca.select("protein_id", position.alias("residue_index"), "f.*")


def _in_file():
    from pyspark.sql import Window

    return Window.partitionBy("protein_id").orderBy("line_number")


def _by_tokens(line: Column) -> Column:
    t = F.split(F.trim(line), r"\s+")
    has_chain = F.length(F.get(t, F.lit(4))) == 1
    at = F.when(has_chain, 6).otherwise(5)
    token = lambda i: F.get(t, i)
    made = F.struct(
        token(F.lit(1)).cast("int").alias("atom_serial"),
        token(F.lit(3)).alias("residue_name"),
        F.when(has_chain, token(F.lit(4))).otherwise("_").alias("chain_id"),
        token(F.when(has_chain, 5).otherwise(4)).cast("int").alias("residue_number"),
        F.lit("").alias("insertion_code"),
        *[token(at + k).cast("double").alias(n) for n, k in (("x", 0), ("y", 1), ("z", 2), ("b_factor", 4))],
    )
    return F.when(F.size(t) >= 11, made).otherwise(F.raise_error(F.concat(F.lit("malformed atom line: "), line)))


def require_atoms(files: DataFrame, residues: DataFrame) -> None:
    """Raises ValueError if a structure has no C-alpha atom."""
    empty = lines(files).select("protein_id").distinct().join(residues, "protein_id", "left_anti").limit(1).collect()
    if empty:
        raise ValueError(f"no C-alpha atom in {empty[0][0]}")


def read_structures(spark: SparkSession, folder: str, pattern: str = "*.pdb", malformed: str = "fallback") -> DataFrame:
    files = structure_files(spark, folder, pattern)
    residues = parse_atoms(lines(files), malformed)
    require_atoms(files, residues)
    return residues


def points_of(residues: DataFrame) -> DataFrame:
    """(grp, id, x, y, z): the coordinates in the form that the neighbourhood operators take."""
    return residues.select(F.col("protein_id").alias("grp"), F.col("residue_index").alias("id"), "x", "y", "z")
