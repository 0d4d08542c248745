"""Who is who: operator keys and labels, plan spellings, accounts and user names.

Three notions of identity stay apart: the operator key (first token, unaccented), the slug
(letters and digits) and the match key (trimmed upper-case text, in ``gaps``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.functions.domain import EMPTY_CELL, NO_NAME
from shiftledger.functions.roles import FULL_VIEW, has_full_view
from shiftledger.functions.text import (
    WHITESPACE, first_token, none_if_blank, operator_key, slug, space_token, strip,
)
from shiftledger.operators.ranking import rank_in_group
from shiftledger.session import cut_lineage

GRAM = 3  # letters of the substrings that names are looked up by


def longest(name: Column | str) -> Column:
    """Aggregate: the longest spelling, the alphabetically first of equally long ones."""
    text = none_if_blank(name)
    return F.min_by(text, F.when(text.isNotNull(), F.struct(-F.length(text), text)))


def label_of(best: Column | str) -> Column:
    return F.coalesce(best, F.lit(NO_NAME))


def operator_labels(spellings: DataFrame) -> DataFrame:
    """One row per operator key with its display label, from raw names that may repeat.

    The names are made distinct first: that step hashes, while an aggregate that keeps text has
    to sort its input, which should then be small.
    """
    return (
        spellings.select("operador_nome").distinct()
        .groupBy(operator_key("operador_nome").alias("op_key"))
        .agg(longest("operador_nome").alias("_best"))
        .select("op_key", label_of("_best").alias("operador_exibicao"))
    )


def operator_spellings(records: DataFrame) -> DataFrame:
    """Every raw name once, with its operator key and the label of that key."""
    names = records.select("operador_nome").distinct()
    return names.withColumn("op_key", operator_key("operador_nome")).join(operator_labels(names), "op_key")


def canonical_operator(records: DataFrame, spellings: DataFrame | None = None) -> DataFrame:
    """Every row with its operator key and label.

    The key is worked out once per spelling and looked up per row. Adaptive execution broadcasts
    the spellings when their measured size allows, and splits the hot names of the record side
    when it does not. Pass stored ``spellings`` to spare the second read; a name they lack keeps
    its own text as label.
    """
    found = operator_spellings(records) if spellings is None else spellings
    found = found.select(F.col("operador_nome").alias("_nome"), F.col("op_key").alias("_key"), "operador_exibicao")
    return records.join(found, F.col("operador_nome").eqNullSafe(F.col("_nome")), "left").select(
        *records.columns,
        F.coalesce("_key", operator_key("operador_nome")).alias("op_key"),
        F.coalesce("operador_exibicao", "operador_nome").alias("operador_exibicao"),
    )


def _grams(text: Column, size: int) -> Column:
    """The distinct substrings of one length; as many as the text has places."""
    places = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size))))


def name_grams(names: DataFrame, column: str, sizes: Iterable[int] = range(1, GRAM + 1)) -> DataFrame:
    """One row per name and substring of one to GRAM letters of it: linear in the length of the names."""
    text = F.lower(F.col(column))
    every = F.array_compact(F.array(*[_grams(text, n) for n in sizes]))
    return names.select(column, F.explode(F.flatten(every)).alias("_grama"))


def search_keys(wanted: DataFrame, column: str, grams: DataFrame) -> DataFrame:
    """The distinct search texts with the substring to look them up by: short ones whole, longer ones by the part fewest names hold.

    A text with a part that no name holds is in no name, and falls out.
    """
    texts = wanted.select(column).where(F.length(column) > 0).distinct()
    short = texts.where(F.length(column) <= GRAM).withColumn("_grama", F.col(column))
    return short.unionByName(_rarest_parts(texts, column, grams))


def _rarest_parts(texts: DataFrame, column: str, grams: DataFrame) -> DataFrame:
    """The distinct texts longer than a gram with that part of theirs which fewest names hold; texts may repeat.

    Shorter ones have no parts here, rather than being filtered: a filter would go below a ``distinct`` that others share, and cost another read of the table.
    """
    long = F.when(F.length(column) > GRAM, F.col(column))
    parts = texts.select(column, F.explode(_grams(long, GRAM)).alias("_grama"))
    held = grams.groupBy("_grama").agg(F.count("*").alias("_n"))
    rarest = parts.join(held, "_grama", "left").groupBy(column).agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_grama")).alias("_chave")
    )
    return rarest.where("_chave.n > 0").select(column, F.col("_chave._grama").alias("_grama"))


def names_holding(wanted: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """Pairs of a (lower-cased) search text and a distinct name that contains it."""
    grams = name_grams(names, name)
    keys = search_keys(wanted, column, grams)
    return keys.join(grams, "_grama").where(F.lower(name).contains(F.col(column))).select(column, name)


def plan_names(schedule: DataFrame) -> DataFrame:
    """Distinct operator spellings of the plan; a blank one shows as '-'."""
    return schedule.select(
        F.coalesce(none_if_blank("operador"), F.lit(EMPTY_CELL)).alias("nome_escala")
    ).distinct()


def contains_name(column: Column | str, name: str) -> Column:
    """Fuzzy operator predicate for one given name: the column contains its first token."""
    token = name.strip().split()[0].lower() if name.strip() else None
    column = F.col(column) if isinstance(column, str) else column
    return F.lit(False) if token is None else F.coalesce(F.lower(strip(column)).contains(token), F.lit(False))


def resolve_operator(records: DataFrame, schedule: DataFrame) -> DataFrame:
    """Distinct raw names with the plan spelling they resolve to.

    A plan name is a hit when it contains the first token of the raw name (the full name and
    equality are special cases). The shortest hit wins, then the alphabetically first; without
    a hit the raw name stays. Accents count. For a token no longer than a gram the best name is
    kept per gram, so one-letter tokens list no names.
    """
    raw = records.select(F.coalesce("operador_nome", F.lit("")).alias("operador_nome")).distinct()
    raw = raw.withColumn("_token", F.lower(first_token("operador_nome")))
    names = plan_names(schedule)
    grams = name_grams(names, "nome_escala")
    best = F.min(F.struct(F.length("nome_escala"), F.col("nome_escala").alias("nome"))).alias("_hit")
    short = grams.groupBy(F.col("_grama").alias("_token")).agg(best)
    parts = name_grams(names, "nome_escala", [GRAM])
    keys = _rarest_parts(raw, "_token", parts)
    held = F.lower("nome_escala").contains(F.col("_token"))
    long = keys.join(parts, "_grama").where(held).groupBy("_token").agg(best)
    return (
        raw.join(short.unionByName(long), "_token", "left")
        .select("operador_nome", F.coalesce(F.col("_hit.nome"), strip("operador_nome")).alias("operador_escala"))
    )


def with_plan_spelling(records: DataFrame, schedule: DataFrame) -> DataFrame:
    """Records with ``operador_escala``; the map has one row per raw spelling."""
    resolved = resolve_operator(records, schedule).withColumnRenamed("operador_nome", "_bruto")
    raw = F.coalesce(F.col("operador_nome"), F.lit(""))
    return records.join(resolved, raw == F.col("_bruto"), "left").drop("_bruto")


def _viewers(users: DataFrame) -> DataFrame:
    """Users with the name that limits their view; null for those who see the whole plan."""
    name = F.when(~has_full_view("role"), F.lower(none_if_blank("nome")))
    return users.select("id", "username", name.alias("nome_busca"))


def schedule_visibility(users: DataFrame, schedule: DataFrame) -> DataFrame:
    """Plan operators per limited viewer name: those whose name contains the viewer's.

    Listed per distinct viewer name and distinct operator, neither per user nor per plan line: ``viewer_scopes`` leads
    from a user to the name, and the operator to the lines.
    """
    viewers = _viewers(users).where("nome_busca IS NOT NULL")
    return names_holding(viewers, "nome_busca", plan_names(schedule), "nome_escala")


def operator_numbers(schedule: DataFrame) -> DataFrame:
    """The distinct plan operators, numbered from 1 in the order of their names."""
    return rank_in_group(plan_names(schedule), [], ["nome_escala"], "numero")


def visibility_bitmaps(users: DataFrame, numbered: DataFrame) -> DataFrame:
    """Which operators a limited viewer name sees, as bitmaps: a line per name and stretch (``faixa``) of 32,768 operator numbers.

    ``numbered`` is ``operator_numbers``, kept beside the result. A name no longer than a gram takes the operators of that gram, each a bit that combines before the
    shuffle; only names found in few operators by their rarest part are looked up one by one. So even one-letter names that everybody holds leave
    as many lines as there are names and stretches, not pairs.
    """
    viewers = _viewers(users).where("nome_busca IS NOT NULL").select("nome_busca").distinct()
    grams = name_grams(numbered, "nome_escala").join(viewers.where(F.length("nome_busca") <= GRAM), F.col("_grama") == F.col("nome_busca"))
    long = names_holding(viewers.where(F.length("nome_busca") > GRAM), "nome_busca", numbered.select("nome_escala"), "nome_escala")
    held = grams.select("nome_busca", "nome_escala").unionByName(long).join(numbered, "nome_escala")
    return held.groupBy("nome_busca", F.bitmap_bucket_number("numero").alias("faixa")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("numero")).alias("operadores")
    )


def lines_seen_by(schedule: DataFrame, numbered: DataFrame, bitmaps: DataFrame, viewer: str) -> DataFrame:
    """The plan lines of the operators whose bit is set for one viewer name."""
    own = bitmaps.where(F.col("nome_busca") == viewer.strip(WHITESPACE).lower()).select("faixa", "operadores")
    at = F.bitmap_bit_position("numero")
    byte = F.conv(F.hex(F.substring(F.col("operadores"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(bitmap_bit_position(numero) % 8 as int)) & 1") == 1
    seen = numbered.join(own, F.bitmap_bucket_number("numero") == F.col("faixa")).withColumn("_byte", byte).where(bit).select("nome_escala")
    name = F.coalesce(none_if_blank("operador"), F.lit(EMPTY_CELL))
    return schedule.join(seen, name == F.col("nome_escala"), "left_semi")


def viewer_scopes(users: DataFrame, schedule: DataFrame) -> DataFrame:
    """Whether a user sees only lines under the own name (``propria``) or the whole plan (``geral``).

    The whole plan goes to full-view roles, to users without a name, and to those whose name is
    in no plan operator. Only whether a name is held is asked, so short names meet distinct grams.
    """
    viewers = _viewers(users)
    names = plan_names(schedule)
    short = name_grams(names, "nome_escala").select(F.col("_grama").alias("nome_busca")).distinct()
    long = names_holding(viewers.where(F.length("nome_busca") > GRAM), "nome_busca", names, "nome_escala").select("nome_busca").distinct()
    hits = short.unionByName(long).withColumn("_propria", F.lit(True))
    return viewers.join(hits, "nome_busca", "left").select(
        "id", "username", F.when(F.col("_propria"), "propria").otherwise("geral").alias("escopo"),
        F.when(F.col("_propria"), F.col("nome_busca")).alias("nome_busca"),
    )


def visible_schedule(schedule: DataFrame, name: str, role: str) -> DataFrame:
    """The plan as one viewer sees it; a blank operator shows, and is searched, as '-'."""
    wanted = name.strip(WHITESPACE).lower()
    if role.strip(WHITESPACE).lower() in FULL_VIEW or not wanted:
        return schedule
    own = schedule.where(F.lower(F.coalesce(none_if_blank("operador"), F.lit(EMPTY_CELL))).contains(wanted))
    return schedule if own.isEmpty() else own


def names_without_account(schedule: DataFrame, users: DataFrame) -> DataFrame:
    """Plan names whose first-token slug belongs to no user."""
    names = schedule.select(none_if_blank("operador").alias("nome")).where("nome IS NOT NULL").distinct()
    used = (
        users.where(F.coalesce("nome", F.lit("")) != "")
        .select(slug(space_token("nome")).alias("_slug")).distinct()
    )
    return (
        names.withColumn("_slug", slug(space_token("nome")))
        .join(used, "_slug", "left_anti").select("nome").orderBy("nome")
    )


AS_WRITTEN_OR_NOT = "UNICODE_CI_AI"  # neither case nor accents count


def _collated(token: Column) -> Column:
    """Only what the slug keeps, compared by collation instead of being rewritten."""
    return F.collate(F.regexp_replace(token, r"[^\p{L}\p{N}\p{M}]", ""), AS_WRITTEN_OR_NOT)


def names_without_account_collated(schedule: DataFrame, users: DataFrame) -> DataFrame:
    """Plan names whose first token equals no user's under the collation; no accent map is involved."""
    names = schedule.select(none_if_blank("operador").alias("nome")).where("nome IS NOT NULL").distinct()
    used = users.where(F.coalesce("nome", F.lit("")) != "").select(_collated(space_token("nome")).alias("_chave")).distinct()
    return names.withColumn("_chave", _collated(space_token("nome"))).join(used, "_chave", "left_anti").select("nome").orderBy("nome")


def spellings_by_collation(records: DataFrame) -> DataFrame:
    """Operator names that the collation takes as one, by first token: a spelling, how many spellings, how many rows."""
    tokens = records.select(space_token(strip("operador_nome")).alias("nome")).where("nome <> ''").groupBy("nome").agg(F.count("*").alias("linhas"))
    return tokens.groupBy(_collated(F.col("nome")).alias("_chave")).agg(
        F.min("nome").alias("nome"), F.count("*").alias("grafias"), F.sum("linhas").alias("linhas")
    ).drop("_chave")


def collation_differences(names: DataFrame, column: str) -> DataFrame:
    """Names that slug and collation class differently: equal slugs under several collation keys, or one collation key over several slugs."""
    told = names.select(F.col(column).alias("nome")).where("nome IS NOT NULL").distinct().select(
        "nome", slug(F.col("nome")).alias("slug"), _collated(F.col("nome")).alias("_chave")
    )
    apart = told.groupBy("slug").agg(F.count_distinct("_chave").alias("n")).where("n > 1").select("slug")
    joined = told.groupBy("_chave").agg(F.count_distinct("slug").alias("n")).where("n > 1").select("_chave")
    split = told.join(apart, "slug", "left_semi").select("nome", "slug", F.lit("separados").alias("diferenca"))
    return split.unionByName(told.join(joined, "_chave", "left_semi").select("nome", "slug", F.lit("juntos").alias("diferenca")))


def _taken_suffixes(taken: DataFrame, bases: DataFrame) -> DataFrame:
    """(base, suffix) for every existing name that is a wanted base plus a usable suffix.

    Suffix 1 stands for the bare base; written suffixes start at 2 and have no leading zero. A
    name ending in digits is tried at each place it can be cut.
    """
    digits = F.length(F.regexp_extract("username", r"(\d*)$", 1))
    cuts = F.transform(
        F.sequence(F.lit(0), digits),
        lambda k: F.struct(
            F.substring(F.col("username"), F.lit(1), F.length("username") - k).alias("base"),
            F.substring(F.col("username"), F.length("username") - k + 1, k).alias("numero"),
        ),
    )
    # Numbers beyond 18 digits are no suffix that a count could reach.
    usable = (F.col("numero") == "") | (F.col("numero").rlike(r"^[1-9]\d{0,17}$") & (F.col("numero") != "1"))
    return (
        taken.select("username").distinct()
        .select(F.inline(cuts)).where(usable)
        .select("base", F.when(F.col("numero") == "", F.lit(1)).otherwise(F.col("numero").try_cast("bigint")).alias("sufixo"))
        .join(bases, "base", "left_semi")
    )


def _below(rows: DataFrame, mark: str, name: str, many: bool = True) -> DataFrame:
    """Per row how many marked rows of its base have a smaller suffix.

    Where there are many rows, stretches of suffixes are summed first, so that no base is one group.
    """
    if not many:
        lower = Window.partitionBy("base").orderBy("sufixo").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(mark).over(lower), F.lit(0)))
    stretch = rows.withColumn("_trecho", F.shiftright("sufixo", _STRETCH_BITS))
    sums = stretch.groupBy("base", "_trecho").agg(F.sum(mark).alias("_n"))
    earlier = Window.partitionBy("base").orderBy("_trecho").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("base", "_trecho").orderBy("sufixo").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("base", "_trecho", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_antes"))
    counted = F.col("_antes") + F.coalesce(F.sum(mark).over(inside), F.lit(0))
    return stretch.join(sums, ["base", "_trecho"]).withColumn(name, counted).drop("_trecho", "_antes")


def _meeting_bases(counted: DataFrame) -> DataFrame:
    """The bases of families in which one ends in a digit, with the highest suffix (``ate``) that each can come to.

    A base comes no further than its family has newcomers and it has taken names.
    """
    bases = counted.groupBy("base").agg(F.count_if(F.col("_tipo") == 0).alias("n"), F.count_if(F.col("_tipo") == 1).alias("t"))
    family = Window.partitionBy(F.regexp_replace("base", _DIGITS, ""))
    told = bases.where("n > 0").withColumns({
        "ate": F.sum("n").over(family) + F.col("t"), "_mistura": F.max(F.col("base").rlike(r"\d$")).over(family),
    })
    return told.where("_mistura").select("base", "ate")


def _shared_names(bases: DataFrame) -> DataFrame:
    """The names that several bases come to: (``nome``, ``base``, ``sufixo``), a line for each base.

    Base "x.y2" with suffix 3 and base "x.y" with suffix 23 are one name. There are about a tenth as many shared names as newcomers of such families.
    """
    digits = F.least(F.length(F.regexp_extract("base", r"(\d*)$", 1)), F.lit(_LONGEST))
    cuts = F.transform(F.sequence(F.lit(1), digits), lambda k: F.struct(
        F.substring(F.col("base"), F.lit(1), F.length("base") - k).alias("curta"), F.substring(F.col("base"), F.length("base") - k + 1, k).alias("d"),
    ))
    longer = bases.where(F.col("base").rlike(r"\d$")).select(F.col("base").alias("longa"), F.col("ate").alias("ate_longa"), F.explode(cuts).alias("c"))
    pairs = longer.select("longa", "ate_longa", "c.curta", F.col("c.d").cast("bigint").alias("d"), F.col("c.d").alias("_texto")).where(~F.col("_texto").startswith("0"))
    pairs = pairs.join(bases.select(F.col("base").alias("curta"), "ate"), "curta")

    def span(size: Column) -> Column:  # suffixes of the longer base that have so many digits, and what their place adds to the shorter one's
        ten = F.pow(F.lit(10), size).cast("bigint")
        fits = F.col("d") <= F.expr("ate") / ten
        return F.struct(
            F.greatest(F.lit(2).cast("bigint"), (ten / 10).cast("bigint")).alias("de"),
            F.when(fits, F.least(ten - 1, F.col("ate_longa"), F.col("ate") - F.col("d") * ten)).otherwise(0).alias("ate_s"), ten.alias("dez"),
        )

    bare = F.struct(F.lit(1).cast("bigint").alias("de"), F.when((F.col("d") > 1) & (F.col("d") <= F.col("ate")), 1).otherwise(0).cast("bigint").alias("ate_s"), F.lit(1).cast("bigint").alias("dez"))
    spans = F.concat(F.array(bare), F.transform(F.sequence(F.lit(1), F.lit(_LONGEST - 1)), span))
    found = pairs.select("longa", "curta", "d", F.explode(F.filter(spans, lambda x: x["ate_s"] >= x["de"])).alias("x")).select("longa", "curta", "d", "x.*")
    size = F.lit(1 << _STRETCH_BITS).cast("bigint")
    found = found.withColumn("_de", F.explode(F.sequence("de", "ate_s", size))).withColumn(
        "s", F.explode(F.sequence(F.col("_de"), F.least(F.col("_de") + size - 1, F.col("ate_s"))))
    )
    name = F.concat("longa", F.when(F.col("s") == 1, "").otherwise(F.col("s").cast("string")))
    short = F.when(F.col("s") == 1, F.col("d")).otherwise(F.col("d") * F.col("dez") + F.col("s"))
    return found.select(name.alias("nome"), F.inline(F.array(
        F.struct(F.col("longa").alias("base"), F.col("s").alias("sufixo")), F.struct(F.col("curta").alias("base"), short.alias("sufixo")),
    ))).distinct()


def _lost(bases: DataFrame, counted: DataFrame) -> DataFrame:
    """The (base, suffix) that a base finds given away, because another base came to that name first.

    A base comes to a suffix with the newcomer whose number is the suffix less what is taken or lost before it; the first to come has the name. Which
    names are lost before depends on the same rule, so it is applied until nothing changes. A round settles at least the earliest name that
    was still wrong, for what decides it lies earlier; so there are no more rounds than shared names, and in practice a few. What stands in the end is
    what a walk in id order gives.
    """
    own = cut_lineage(counted.join(bases.select("base"), "base", "left_semi"))
    used = own.where("_tipo = 1").select("base", F.col("_chave").alias("sufixo"))
    newcomers = own.where("_tipo = 0").select("base", F.col("_n").alias("_k"), F.col("_chave").alias("chega"))
    claims = _shared_names(bases).join(used, ["base", "sufixo"], "left_anti")
    marked = claims.withColumn("_tomado", F.lit(0)).unionByName(used.withColumn("_tomado", F.lit(1)).withColumn("nome", F.lit(None).cast("string")))
    state = _below(marked, "_tomado", "tomados").where("nome IS NOT NULL").drop("_tomado")
    longest = Window.partitionBy("nome").orderBy(F.desc(F.length("base")))  # as many lines as the name has bases
    state = cut_lineage(state.withColumn("perdido", (F.row_number().over(longest) > 1).cast("int")))
    many = state.count() > _MANY
    while True:
        told = _below(state, "perdido", "_perdidos", many).withColumn("_k", F.col("sufixo") - F.col("tomados") - F.col("_perdidos"))
        told = told.join(newcomers, ["base", "_k"], "left")
        first = F.min("chega").over(Window.partitionBy("nome"))
        lost = F.coalesce((F.coalesce(F.col("chega") > first, F.lit(True))) & first.isNotNull(), F.lit(False)).cast("int")
        told = cut_lineage(told.select("nome", "base", "sufixo", "tomados", lost.alias("perdido"), (lost != F.col("perdido")).alias("_mudou")))
        state = told.drop("_mudou")
        if told.where("_mudou").isEmpty():
            return state.where("perdido = 1").select("base", "sufixo")


_MANY = 1 << 18  # beyond, the shared names of one base are not worked on in one task; the result is the same
_STRETCH_BITS = 16
_LONGEST = 18  # digits of a suffix
_DIGITS = r"\d+$"


def assign_usernames(newcomers: DataFrame, taken: DataFrame) -> DataFrame:
    """A free user name for every newcomer (``id``, ``nome``, ``sobrenome``), as if they came one by one in id order.

    The k-th newcomer of a base takes the k-th free suffix. A taken suffix t that is the j-th of its base has t - j free places before it. Put
    taken suffixes at t - j and newcomers at k, newcomers first on a tie: the position of a newcomer in this merged order is its
    suffix. Bases that are another base plus digits come to some names of that one; those few are settled first (``_lost``) and count as taken. All is
    done by positions, so a family that holds a third of the newcomers spreads over many tasks.
    """
    token = slug(space_token(strip("nome")))
    # Written once: the base is costly to work out and is used several times below.
    waiting = cut_lineage(newcomers.select("id", F.concat(token, F.lit("."), slug("sobrenome")).alias("base")))
    used = _taken_suffixes(taken, waiting.select("base").distinct())
    kinds = lambda suffixes: waiting.select("base", F.lit(0).alias("_tipo"), F.col("id").alias("_chave")).unionByName(
        suffixes.select("base", F.lit(1).alias("_tipo"), F.col("sufixo").alias("_chave"))
    )
    counted = rank_in_group(kinds(used), ["base", "_tipo"], ["_chave"], "_n")
    bases = cut_lineage(_meeting_bases(counted))
    if not bases.isEmpty():
        lost = _lost(bases, counted)
        both = counted.where("_tipo = 1").select("base", F.col("_chave").alias("sufixo")).join(bases.select("base"), "base", "left_semi").unionByName(lost)
        again = rank_in_group(both, ["base"], ["sufixo"], "_n").select("base", F.lit(1).alias("_tipo"), F.col("sufixo").alias("_chave"), "_n")
        other = counted.where("_tipo = 1").join(bases.select("base"), "base", "left_anti")
        counted = counted.where("_tipo = 0").unionByName(other).unionByName(again)
    place = F.when(F.col("_tipo") == 0, F.col("_n")).otherwise(F.col("_chave") - F.col("_n"))
    merged = rank_in_group(counted.withColumn("_lugar", place), ["base"], ["_lugar", "_tipo", "_chave"], "sufixo")
    number = F.when(F.col("sufixo") == 1, "").otherwise(F.col("sufixo").cast("string"))
    return merged.where("_tipo = 0").select(F.col("_chave").alias("id"), "base", F.concat("base", number).alias("username"))
