"""Machine-readable zones: locating, parsing and verifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, mrz as zone

# Field positions of the three ICAO 9303 formats: (line, first column, length).
WIDTH = {"TD3": 44, "TD2": 36, "TD1": 30}
_TWO_LINE = {
    "number": (2, 1, 9), "number_cd": (2, 10, 1), "nationality": (2, 11, 3),
    "birth": (2, 14, 6), "birth_cd": (2, 20, 1), "sex": (2, 21, 1),
    "expiry": (2, 22, 6), "expiry_cd": (2, 28, 1), "names": (1, 6, 39),
}
LAYOUT = {
    "TD3": {**_TWO_LINE, "optional2": (2, 29, 15), "composite_cd": (2, 44, 1)},
    "TD2": {**_TWO_LINE, "optional2": (2, 29, 7), "composite_cd": (2, 36, 1)},
    "TD1": {
        "number": (1, 6, 9), "number_cd": (1, 15, 1), "optional1": (1, 16, 15),
        "birth": (2, 1, 6), "birth_cd": (2, 7, 1), "sex": (2, 8, 1),
        "expiry": (2, 9, 6), "expiry_cd": (2, 15, 1), "nationality": (2, 16, 3),
        "optional2": (2, 19, 11), "composite_cd": (2, 30, 1), "names": (3, 1, 30),
    },
}

MRZ_SCHEMA = (
    "struct<format:string,line1:string,line2:string,line3:string,document_type:string,country:string,"
    "surname:string,given_names:string,document_number:string,nationality:string,birth_date:string,"
    "sex:string,expiry_date:string,optional_data:string,"
    "checksums:array<struct<field:string,value:string,check_digit:string,calculated_check_digit:string,valid:boolean>>,"
    "is_valid:boolean>"
)


def parse_mrz_lines(
    df: DataFrame, fmt: Column | str, line1: str = "line1", line2: str = "line2", line3: str | None = None,
) -> DataFrame:
    """Add a typed ``mrz`` struct parsed from raw lines.

    ``fmt`` is TD1, TD2, TD3 or NULL (no zone, NULL struct), either fixed or
    decided per row, so a mixed table is parsed in one pass.
    """
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    staged = df.withColumn("_fmt", fmt)
    width = F.coalesce(
        *[F.when(F.col("_fmt") == name, F.lit(size)) for name, size in WIDTH.items()]
    )
    sources = {1: F.col(line1), 2: F.col(line2), 3: F.col(line3) if line3 else F.lit(None).cast("string")}
    # Each stage names what the next one uses several times, so that no expression
    # is repeated inside another and generated code stays small.
    staged = staged.withColumn("_width", width)
    staged = staged.withColumns({f"_c{n}": zone.clean_line(source) for n, source in sources.items()})
    staged = staged.withColumns(
        {f"_l{n}": zone.restore_length(F.col(f"_c{n}"), F.col("_width")) for n in sources}
    )

    def cut(name: str) -> Column:
        pieces = [
            F.when(F.col("_fmt") == kind, F.substring(F.col(f"_l{spec[name][0]}"), *spec[name][1:]))
            for kind, spec in LAYOUT.items()
            if name in spec
        ]
        return F.coalesce(*pieces, F.lit(""))

    numeric = ("birth", "birth_cd", "expiry", "expiry_cd", "number_cd", "composite_cd")
    plain = ("number", "nationality", "sex", "optional1", "optional2", "names")
    staged = staged.withColumns({f"_{n}": cut(n) for n in numeric + plain})
    staged = staged.withColumns({f"_{n}": zone.as_digits(F.col(f"_{n}")) for n in numeric})
    c = lambda n: F.col(f"_{n}")

    def payload(opt1: Column, opt2: Column) -> Column:
        return F.concat(
            c("number"), c("number_cd"), opt1, c("birth"), c("birth_cd"), c("expiry"), c("expiry_cd"), opt2
        )

    staged = staged.withColumns(
        {
            "_number_calc": zone.check_digit(c("number")),
            "_birth_calc": zone.check_digit(c("birth")),
            "_expiry_calc": zone.check_digit(c("expiry")),
            "_composite_calc": zone.check_digit(payload(c("optional1"), c("optional2"))),
        }
    )
    # Issuers put letters or digits in the optional data: either reading may validate.
    composite_ok = (c("composite_cd") == c("composite_calc")) | (
        c("composite_cd")
        == zone.check_digit(payload(zone.as_digits(c("optional1")), zone.as_digits(c("optional2"))))
    )

    def checksum(field: str, value: Column, digit: str, ok: Column | None = None) -> Column:
        return F.struct(
            F.lit(field).alias("field"),
            value.alias("value"),
            c(f"{digit}_cd").alias("check_digit"),
            c(f"{digit}_calc").alias("calculated_check_digit"),
            (c(f"{digit}_cd") == c(f"{digit}_calc") if ok is None else ok).alias("valid"),
        )

    number, birth, expiry, composite = fixed.CHECKSUM_FIELDS
    sums = F.array(
        checksum(number, c("number"), "number"),
        checksum(birth, c("birth"), "birth"),
        checksum(expiry, c("expiry"), "expiry"),
        checksum(composite, F.lit("Composite Checksum Payload"), "composite", composite_ok),
    )
    staged = staged.withColumn("_sums", sums)
    head = zone.without_filler(F.substring(F.col("_l1"), 1, 2))
    body = F.struct(
        c("fmt").alias("format"),
        c("l1").alias("line1"),
        c("l2").alias("line2"),
        F.when(c("fmt") == "TD1", c("l3")).alias("line3"),
        F.when(head != "", head).when(c("fmt") == "TD3", "P").otherwise("I").alias("document_type"),
        zone.as_letters(zone.without_filler(F.substring(F.col("_l1"), 3, 3))).alias("country"),
        zone.name_piece(c("names"), 0).alias("surname"),
        zone.name_piece(c("names"), 1).alias("given_names"),
        zone.without_filler(c("number")).alias("document_number"),
        zone.as_letters(zone.without_filler(c("nationality"))).alias("nationality"),
        c("birth").alias("birth_date"),
        F.when(c("sex") == "<", "X").otherwise(c("sex")).alias("sex"),
        c("expiry").alias("expiry_date"),
        zone.without_filler(F.concat(c("optional1"), c("optional2"))).alias("optional_data"),
        c("sums").alias("checksums"),
        F.forall(c("sums"), lambda s: s["valid"]).alias("is_valid"),
    )
    present = c("fmt").isNotNull() & sources[1].isNotNull() & sources[2].isNotNull()
    present = present & ((c("fmt") != "TD1") | sources[3].isNotNull())
    # Exploding a one-element array keeps the row as it is, and keeps filters on the
    # parsed fields above the parse: pushed below it, they would repeat every stage.
    kept = [x for x in df.columns if x != "mrz"]
    return staged.select(*kept, F.explode(F.array(F.when(present, body))).alias("mrz"))


def checksums_long(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per (document, checksum field)."""
    long = parsed.select(key, F.posexplode("mrz.checksums").alias("pos", "c"))
    return long.select(
        key,
        (F.col("pos") + 1).alias("checksum_no"),
        F.col("c.field").alias("field"),
        F.col("c.value").alias("value"),
        F.col("c.check_digit").alias("check_digit"),
        F.col("c.calculated_check_digit").alias("calculated_check_digit"),
        F.col("c.valid").alias("valid"),
    )


def find_mrz_lines(docs: DataFrame) -> DataFrame:
    """Pick each document's zone out of its ordered text lines.

    Adds fmt, line1, line2, line3 to a table with a ``lines`` array. Three
    readings in order of trust: three long filler-bearing lines in a row (TD1),
    two in a row (TD3), else up to three scattered filler-heavy lines. All of a
    document's lines are in its own row, so nothing is shuffled.
    """
    given = F.filter(F.col("lines"), lambda line: F.coalesce(line, F.lit("")) != "")
    df = docs.withColumn("_clean", F.transform(given, zone.clean_line))
    clean = F.col("_clean")

    def shaped(line: Column, size: int) -> Column:
        return F.coalesce((F.length(line) >= size) & F.contains(line, F.lit("<")), F.lit(False))

    def run_starts(length: int, size: int):
        def starts(line: Column, i: Column) -> Column:
            ok = shaped(line, size)
            for step in range(1, length):
                ok = ok & shaped(F.get(clean, i + step), size)
            return ok

        return F.array_position(F.transform(clean, starts), True)

    def heavy(line: Column) -> Column:
        fillers = F.length(line) - F.length(F.regexp_replace(line, "<", ""))
        return (F.length(line) >= 30) & (fillers >= 4)

    df = df.withColumns(
        {
            "_triple": run_starts(3, 25).cast("int"),
            "_pair": run_starts(2, 30).cast("int"),
            "_heavy": F.slice(F.filter(clean, heavy), 1, 3),
        }
    )
    triple, pair, loose = F.col("_triple"), F.col("_pair"), F.col("_heavy")

    def pick(n: int) -> Column:
        return (
            F.when(triple > 0, F.get(clean, triple - 1 + n))
            .when(pair > 0, F.get(clean, pair - 1 + n) if n < 2 else F.lit(None))
            .when(F.size(loose) >= 2, F.get(loose, F.lit(n)))
        )

    fmt = (
        F.when((triple > 0), "TD1")
        .when(pair > 0, "TD3")
        .when(F.size(loose) == 3, "TD1")
        .when(F.size(loose) == 2, "TD3")
    )
    return df.select(
        *docs.columns,
        fmt.alias("fmt"),
        *[pick(n).alias(f"line{n + 1}") for n in range(3)],
    )


def parse_mrz(docs: DataFrame) -> DataFrame:
    """Parse the isolated band if it holds two lines, else the lines found in the text.

    ``docs``: doc_id, document_type, band (array of already isolated lines),
    fmt/line1/line2/line3 from :func:`find_mrz_lines`. Card types that carry no
    zone get a NULL ``mrz`` whatever their text looks like.
    """
    band = F.filter(F.col("band"), lambda line: F.coalesce(line, F.lit("")) != "")
    use_band = F.coalesce(F.size(band) >= 2, F.lit(False))
    no_zone = F.col("document_type").isin(*fixed.NON_MRZ_TYPES)
    chosen = docs.withColumns(
        {
            "fmt": F.when(no_zone, F.lit(None))
            .when(use_band, F.when(F.size(band) >= 3, "TD1").otherwise("TD3"))
            .otherwise(F.col("fmt")),
            "line1": F.when(use_band, F.get(band, F.lit(0))).otherwise(F.col("line1")),
            "line2": F.when(use_band, F.get(band, F.lit(1))).otherwise(F.col("line2")),
            "line3": F.when(use_band, F.get(band, F.lit(2))).otherwise(F.col("line3")),
        }
    )
    return parse_mrz_lines(chosen, F.col("fmt"), "line1", "line2", "line3").drop(
        "fmt", "line1", "line2", "line3", "band"
    )
