"""Resolving municipality codes and names against a catalog ``ibge_code, name, state``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civigrade.functions.text import cell_text, drop_fields, once, parse_place_name, place_name_key, put_fields
from civigrade.operators.joins import attach_counted, lookup, upsert

CODE_FIELD = "municipality_ibge_code"
CODE_SOURCE_FIELD = "municipality_code_source"
LOOKUP_SOURCE = "ibge_lookup"


def code_text(cell: Column) -> Column:
    """Text of a code cell without a zero fraction."""
    return F.regexp_replace(cell_text(cell), r"\.0+$", "")


def code_keys(municipalities: DataFrame) -> DataFrame:
    """Every accepted spelling of a code: all seven digits, or six where only one code starts with them."""
    codes = municipalities.select("ibge_code").distinct()
    prefixes = (
        codes.groupBy(F.left("ibge_code", F.lit(6)).alias("code_key"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("ibge_code").alias("ibge_code"))
        .filter(F.col("n") == 1)
    )
    return codes.select(F.col("ibge_code").alias("code_key"), "ibge_code").unionByName(prefixes.select("code_key", "ibge_code"))


def resolve_codes(df: DataFrame, cell: Column, municipalities: DataFrame, alias: str = "municipality_code") -> DataFrame:
    """Add the seven-digit code of a code cell; null when unknown or not unique."""
    keys = lookup(code_keys(municipalities).select("code_key", F.col("ibge_code").alias(alias)))
    return df.withColumn("code_key", code_text(cell)).join(keys, "code_key", "left").drop("code_key")


def _name_keys(municipalities: DataFrame) -> DataFrame:
    """One row per name with state, bare name, code and code prefix: number of municipalities and the first one."""
    name = place_name_key(F.col("name"))
    spellings = F.array(
        F.concat_ws("|", F.lit("s"), name, "state"),
        F.concat_ws("|", F.lit("n"), name),
        F.concat_ws("|", F.lit("c"), "ibge_code"),
        F.concat_ws("|", F.lit("c"), F.left("ibge_code", F.lit(6))),
    )
    return (
        municipalities.withColumn("name_key", F.explode(spellings))
        .groupBy("name_key")
        .agg(F.count(F.lit(1)).alias("candidate_count"), F.min(F.struct("ibge_code", "name", "state")).alias("candidate"))
    )


def _original_key(original: Column) -> Column:
    code = F.regexp_extract(original, r"^([0-9]{6,7})(\.0+)?$", 1)

    def key(parsed: Column) -> Column:
        name = F.when(parsed.isNotNull(), parsed["name"]).otherwise(original)
        named = F.concat_ws("|", place_name_key(name), parsed["state"])
        return F.when(code != "", F.concat(F.lit("c|"), code)).otherwise(
            F.concat(F.when(parsed.isNotNull(), F.lit("s|")).otherwise(F.lit("n|")), named)
        )

    return once(parse_place_name(original), key)


def match_names(rows: DataFrame, field: Column, municipalities: DataFrame) -> DataFrame:
    """Add ``original_name, status, suggestion, candidate_count`` per row.

    A name with state or a code is matched when exactly one municipality fits; a bare name is at best
    ambiguous. The candidates of ambiguous names come from :func:`candidates_of`.
    """
    original = cell_text(field)
    keyed = rows.withColumn("original_name", original).withColumn("name_key", _original_key(F.col("original_name")))
    found = keyed.join(lookup(_name_keys(municipalities)), "name_key", "left")
    count = F.when(F.col("original_name") == "", 0).otherwise(F.coalesce("candidate_count", F.lit(0)))
    kind = F.left("name_key", F.lit(1))
    status = (
        F.when(count == 0, "unmatched")
        .when(kind == "n", "ambiguous")
        .when(count == 1, "matched")
        .when(kind == "s", "ambiguous")
        .otherwise("unmatched")
    )
    return (
        found.withColumn("status", status)
        .withColumn("suggestion", F.when(F.col("status") == "matched", F.col("candidate")))
        .withColumn("candidate_count", F.when(F.col("status") == "ambiguous", count).otherwise(0).cast("long"))
        .drop("name_key", "candidate")
    )


def candidates_of(matches: DataFrame, municipalities: DataFrame) -> DataFrame:
    """The municipalities behind each distinct ambiguous text, one row per pair."""
    names = matches.filter(F.col("status") == "ambiguous").select("original_name").distinct()
    names = names.withColumn("name_key", _original_key(F.col("original_name")))
    key = place_name_key(F.col("name"))
    spellings = F.array(F.concat_ws("|", F.lit("s"), key, "state"), F.concat_ws("|", F.lit("n"), key))
    catalog = municipalities.withColumn("name_key", F.explode(spellings))
    return names.join(catalog, "name_key").select("original_name", "ibge_code", "name", "state")


def group_matches(matches: DataFrame) -> DataFrame:
    """One row per original text (blank left out) with status, suggestion and number of rows.

    Use :func:`ordered_groups` to list them; row numbers stay in ``matches``.
    """
    return (
        matches.filter(F.col("original_name") != "")
        .groupBy("original_name")
        .agg(
            F.min("status").alias("status"),
            F.min("suggestion").alias("suggestion"),
            F.max("candidate_count").alias("candidate_count"),
            F.count(F.lit(1)).alias("rows"),
        )
    )


def ordered_groups(groups: DataFrame) -> DataFrame:
    """Pending texts first, then by number of rows, then by text."""
    return groups.orderBy((F.col("status") == "matched").asc(), F.col("rows").desc(), F.col("original_name").asc())


def blank_names(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count_if(F.col("original_name") == "").alias("blank_rows"))


def decide(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Groups with the user's decisions (``original_name, ibge_code, origin``) and the resulting choice.

    A decision without code rejects the suggestion. ``filter`` columns tell the lists a group shows in.
    """
    made = decisions.select(
        "original_name", F.col("ibge_code").alias("decided_code"), F.col("origin").alias("decided_origin"),
        F.lit(True).alias("is_changed"),
    )
    joined = groups.join(lookup(made), "original_name", "left").withColumn("is_changed", F.coalesce("is_changed", F.lit(False)))
    suggested = F.when(F.col("status") == "matched", F.col("suggestion")["ibge_code"])
    chosen = F.when(F.col("is_changed"), F.col("decided_code")).otherwise(suggested)
    is_exact = ~F.col("is_changed") | F.coalesce(suggested == F.col("decided_code"), F.lit(False))
    return (
        joined.withColumn("is_pending", (F.col("status") != "matched") & ~F.col("is_changed"))
        .withColumn("is_exact", (F.col("status") == "matched") & ~F.col("is_changed"))
        .withColumn("chosen_code", F.when(F.trim(chosen).rlike("^[0-9]{7}$"), F.trim(chosen)))
        .withColumn("origin", F.when(is_exact, F.lit("exact")).otherwise(F.col("decided_origin")))
        .drop("decided_code", "decided_origin")
    )


def confirmed_matches(matches: DataFrame, decided: DataFrame) -> DataFrame:
    """``row_number, ibge_code, origin`` of every row whose text has a chosen code."""
    keys = [c for c in ("import_id", "sheet_name") if c in matches.columns]
    named = matches.select(*keys, "row_number", "original_name").filter(F.col("original_name") != "")
    joined = attach_counted(named, decided.select("original_name", "chosen_code", "origin", "rows"), ["original_name"])
    return joined.filter(F.col("chosen_code").isNotNull()).select(
        *keys, "row_number", F.col("chosen_code").alias("ibge_code"), "origin"
    )


def check_matches(confirmed: DataFrame, matches: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Problems of confirmed matches (``row_number, problem``): unknown code, unknown row, row sent twice, not confirmed.

    ``confirmed`` and ``matches`` cover one sheet.
    """
    codes = municipalities.select("ibge_code").distinct()
    unknown_code = confirmed.join(lookup(codes), "ibge_code", "left_anti").select("row_number", F.lit("unknown code").alias("problem"))
    known = matches.select("row_number", "original_name", "status", "suggestion")
    unknown_row = confirmed.join(known, "row_number", "left_anti").select("row_number", F.lit("unknown row").alias("problem"))
    twice = (
        confirmed.groupBy("row_number").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        .select("row_number", F.lit("row sent twice").alias("problem"))
    )
    checked = confirmed.filter(F.col("origin") != "manual").join(known, "row_number")
    exact = F.coalesce((F.col("status") == "matched") & (F.col("suggestion")["ibge_code"] == F.col("ibge_code")), F.lit(False))
    # A candidate holds when the chosen municipality has the key of the text: one equi join, no candidate lists.
    name = place_name_key(F.col("name"))
    spelled = municipalities.select(
        "ibge_code",
        F.explode(
            F.array(
                F.concat_ws("|", F.lit("s"), name, "state"), F.concat_ws("|", F.lit("n"), name),
                F.concat_ws("|", F.lit("c"), "ibge_code"), F.concat_ws("|", F.lit("c"), F.left("ibge_code", F.lit(6))),
            )
        ).alias("name_key"),
    )
    keyed = checked.withColumn("name_key", _original_key(F.col("original_name"))).withColumn("is_exact", exact)
    wrong_exact = keyed.filter((F.col("origin") == "exact") & ~F.col("is_exact"))
    wrong_candidate = keyed.filter(F.col("origin") != "exact").join(lookup(spelled), ["ibge_code", "name_key"], "left_anti")
    not_confirmed = wrong_exact.select("row_number").unionByName(wrong_candidate.select("row_number"))
    not_confirmed = not_confirmed.withColumn("problem", F.lit("does not match the name"))
    return unknown_code.unionByName(unknown_row).unionByName(twice).unionByName(not_confirmed)


def apply_matches(staged: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Write confirmed codes into the prepared cells; codes of an earlier lookup not confirmed again are cleared."""
    keys = [c for c in ("import_id", "sheet_name") if c in confirmed.columns] + ["row_number"]
    codes = confirmed.select(*keys, F.col("ibge_code").alias("_code"))
    joined = staged.join(codes, keys, "left")
    before = F.try_element_at("normalized_row", F.lit(CODE_SOURCE_FIELD))
    cleared = F.when(before == LOOKUP_SOURCE, drop_fields(F.col("normalized_row"), [CODE_FIELD, CODE_SOURCE_FIELD]))
    written = put_fields(F.col("normalized_row"), {CODE_FIELD: F.col("_code"), CODE_SOURCE_FIELD: F.lit(LOOKUP_SOURCE)})
    row = F.when(F.col("_code").isNotNull(), written).otherwise(F.coalesce(cleared, F.col("normalized_row")))
    return joined.withColumn("normalized_row", row).select(*staged.columns)


def search_catalog(municipalities: DataFrame, search: str, limit: int = 20) -> DataFrame:
    """Catalog rows for a search text: digits are a code prefix, text (two characters at least) part of the name."""
    text = search.strip()
    if limit < 1:
        raise ValueError("a page needs a positive limit")
    if text.isdigit():
        return municipalities.filter(F.startswith("ibge_code", F.lit(text))).orderBy("ibge_code").limit(limit)
    parsed = parse_place_name(F.lit(text))
    wanted = place_name_key(F.coalesce(parsed["name"], F.lit(text)))
    name = place_name_key(F.col("name"))
    fits = (F.length(wanted) >= 2) & F.contains(name, wanted) & (parsed.isNull() | (F.col("state") == parsed["state"]))
    return (
        municipalities.filter(F.coalesce(fits, F.lit(False)))
        .orderBy(F.startswith(name, wanted).desc(), "name", "state", "ibge_code")
        .limit(limit)
    )


def search_registered(municipalities: DataFrame, search: str = "", limit: int = 20) -> DataFrame:
    """First municipalities by name whose code or name contains the text."""
    pattern = f"%{search.strip()}%"
    rows = municipalities
    if search.strip():
        rows = rows.filter(F.col("ibge_code").ilike(pattern) | F.col("name").ilike(pattern))
    return rows.orderBy("name", "ibge_code").limit(limit)


def register(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Catalog with the incoming municipalities added or renamed."""
    return upsert(current, incoming, ["ibge_code"])


def catalog_from_regions(raw: DataFrame) -> DataFrame:
    """Catalog from the nested localities document: the state sits below one of two region branches."""
    schema = raw.schema
    branches = []
    for region, wider in (("microrregiao", "mesorregiao"), ("regiao-imediata", "regiao-intermediaria")):
        if region in schema.fieldNames():
            inner = schema[region].dataType
            # Either branch may hold either of the wider regions.
            for name in ("mesorregiao", "regiao-intermediaria"):
                if name in getattr(inner, "names", []):
                    branches.append((F.col(f"`{region}`").isNotNull(), F.col(f"`{region}`.`{name}`")["UF"]["sigla"]))
    if not branches:
        raise ValueError("the document has no region branch that tells the state")
    return raw.select(
        F.lpad(F.col("id").cast("string"), 7, "0").alias("ibge_code"),
        F.col("nome").alias("name"),
        F.coalesce(*[state for _, state in branches]).alias("state"),
    )


def population_from_rows(raw: DataFrame) -> DataFrame:
    """``ibge_code, inhabitants`` of the statistics rows ``D1C, V``: seven-character codes with a whole number."""
    code, value = F.trim(F.col("D1C").cast("string")), F.trim(F.col("V").cast("string"))
    kept = raw.filter((F.length(code) == 7) & value.rlike("^[0-9]+$"))
    return kept.select(code.alias("ibge_code"), value.try_cast("long").alias("inhabitants"))
