"""Quality rules whose cutoffs are chosen under a guaranteed rate of false rejections.

Every rule is a number per document that is high for poor texts. A labelled
holdout decides, stratum by stratum, from which value on a rule may reject: the
exact binomial bound on its false rejections must hold at a confidence that is
shared among all cutoffs tried, and so must the bound on what all rules reject together.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotproof.functions.geometry import bind
from plotproof.session import materialise

# Word separators, symbols and base limits of the contract.
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
RUN = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

METRICS = ("n_palavras", "n_caracteres", "n_simbolos", "n_linhas_repetidas", "n_palavras_repetidas")

#: Rules: each a ratio of two measures, per thousand, high for poor texts.
RULES = {
    "simbolos": ("n_simbolos", "n_caracteres"),
    "linhas_repetidas": ("n_linhas_repetidas", "n_linhas"),
    "palavras_repetidas": ("n_palavras_repetidas", "n_palavras"),
    "maiusculas": ("n_maiusculas", "n_caracteres"),
    "barras": ("n_barras", "n_palavras"),
}
#: Cutoffs tried for each rule, per thousand: a rule rejects above its cutoff.
CUTOFFS = (0, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _repeated(words: Column, n: Column) -> Column:
    """Words inside a run of RUN words found twice or more in ``words``."""
    at = F.sequence(F.lit(0), n - RUN)
    runs = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(RUN)]))

    def covered(found: Column) -> Column:
        # found: positions of repeated runs, ascending; each covers RUN words up to the next one's start.
        # Past the last one ``get`` is null, which ``least`` skips.
        return F.aggregate(
            F.sequence(F.lit(0), F.size(found) - 1),
            F.lit(0),
            lambda acc, k: acc + F.least(F.lit(RUN), F.get(found, k + 1) - F.get(found, k)),
        )

    def repeats(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        positions = bind(
            pairs,
            lambda p: F.array_sort(
                F.filter(
                    F.transform(
                        p,
                        lambda x, k: F.when(
                            F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)),
                            x["i"],
                        ),
                    ),
                    lambda i: i.isNotNull(),
                )
            ),
        )
        return bind(positions, covered)

    # Most texts repeat nothing; a set of hashes tells so without sorting.
    counted = bind(runs, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats(h)))
    return F.when(n < RUN, F.lit(0)).otherwise(counted)


def measure(documento: DataFrame, com_texto: bool = False) -> DataFrame:
    """Input rows, ``texto`` left out unless ``com_texto``, with the measures of the text (null: empty) and ``reprovado_base``."""
    text = F.coalesce(F.col("texto"), F.lit(""))
    words = _words(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = F.length(F.translate(text, BLANK_CHARS, ""))
    counts = bind(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w, F.size(w)).alias("r")))
    line_counts = bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    dropped = {"reprovado_base", *METRICS, *EXTRA} | (set() if com_texto else {"texto"})
    kept = [c for c in documento.columns if c.lower() not in dropped]
    measured = documento.select(
        *kept,
        counts.alias("_w"),
        line_counts.alias("_l"),
        without.cast("long").alias("n_caracteres"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_simbolos"),
        (F.length(text) - F.length(F.translate(text, "|", ""))).cast("long").alias("n_barras"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_maiusculas"),
    )
    named = measured.select(
        *kept,
        F.col("_w.n").cast("long").alias("n_palavras"),
        "n_caracteres",
        "n_simbolos",
        (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_linhas_repetidas"),
        F.col("_w.r").cast("long").alias("n_palavras_repetidas"),
        F.col("_l.n").cast("long").alias("n_linhas"),
        "n_maiusculas",
        "n_barras",
    )
    failed = (F.col("n_palavras") < MIN_WORDS) | (
        100 * F.col("n_palavras_repetidas") > MAX_REPEAT_PERCENT * F.col("n_palavras")
    )
    return named.withColumn("reprovado_base", failed)


EXTRA = ("n_linhas", "n_maiusculas", "n_barras")


def _rate(rule: str) -> Column:
    top, bottom = RULES[rule]
    return 1000 * F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def _binomial_tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X binomial (n, p), by the exact recurrence of its terms in log space."""
    start = F.struct((n * log(1 - p)).alias("term"), (n * log(1 - p)).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(log(p / (1 - p)))
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(acc["total"] - high) + F.exp(term - high))).alias("total"))

    return F.when(k < 1, start["total"]).otherwise(
        F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step)["total"]
    )


def choose_cutoffs(
    medido: DataFrame, estrato: str, max_recusa: float = 0.01, confianca: float = 0.95, regras=tuple(RULES)
) -> DataFrame:
    """Cutoff of every rule in every stratum: rows (``estrato``, ``regra``, ``corte``, ``n_boas``, ``n_recusadas``).

    ``medido``: measured labelled rows with ``qualidade`` (1 good, 0 poor). A cutoff is
    valid when k false rejections among the stratum's n good documents are so few that
    the exact binomial probability of at most k, at a true rate of ``max_recusa``, is
    no more than (1 - ``confianca``) divided by the number of cutoffs tried over all
    rules and strata. Of the valid cutoffs the one that rejects most poor documents is
    taken, and of equals the most lenient. A rule without one rejects nothing there.

    A document goes when any rule rejects it, so the cutoffs must also hold together:
    rules are taken up from the one that rejects most poor documents, and a cutoff is
    taken only when the good documents rejected by it or by a rule before it pass the
    same test, with the error shared among all choices open to the stratum. Choices that
    reject the same poor documents rule by rule count once, as their most lenient; poor
    documents are another sample than the good ones, so they may tell what is tried.
    """

    def level(rate: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: rate > c))

    # Documents alike in stratum, label and cutoffs exceeded count as one row.
    alike = materialise(
        medido.where("qualidade in (0, 1) and not reprovado_base")
        .groupBy(
            F.coalesce(F.col(estrato).cast("string"), F.lit("")).alias("estrato"), "qualidade", F.array(*[level(_rate(r)) for r in regras]).alias("niveis")
        )
        .agg(F.count("*").alias("n")),
        "amostra",
    )
    tried = alike.select("estrato", "qualidade", "n", F.posexplode("niveis").alias("regra", "nivel")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(len(CUTOFFS) - 1))).alias("corte")
    )

    def total(quality: int, exceeded: bool) -> Column:
        counts = (F.col("qualidade") == quality) & (F.col("nivel") > F.col("corte") if exceeded else F.lit(True))
        return F.sum(F.when(counts, F.col("n")).otherwise(0))

    tested = tried.groupBy("estrato", "regra", "corte").agg(
        total(1, False).alias("n_boas"), total(1, True).alias("n_recusadas"), total(0, True).alias("n_ruins")
    )
    # One row against a few: the count of strata.
    tested = tested.join(F.broadcast(alike.agg(F.count_distinct("estrato").alias("_estratos"))))
    error = F.log((1 - confianca) / F.col("_estratos"))

    def holds(k: Column, n: Column, share: Column) -> Column:
        return (k < max_recusa * n) & (_binomial_tail(k, n, max_recusa) <= share)

    valid = tested.where(
        (F.col("n_boas") > 0)
        & (F.col("n_ruins") > 0)
        & holds(F.col("n_recusadas"), F.col("n_boas"), error - log(len(regras) * len(CUTOFFS)))
    )
    # Log share of the error for every choice of cutoffs, rule by rule none or one that rejects its own number of poor ones.
    choices = tested.where("n_ruins > 0").groupBy("estrato", "regra").agg(F.count_distinct("n_ruins").alias("k"))
    choices = choices.groupBy("estrato").agg((-F.sum(F.log(F.col("k") + 1))).alias("_parte"))
    # One row per stratum: its valid cutoffs rule by rule, best first, and the cutoff taken for every rule.
    cutoffs = valid.groupBy("estrato", "_estratos", "n_boas", "regra").agg(
        F.sort_array(F.collect_list(F.struct("n_ruins", "corte", "n_recusadas")), asc=False).alias("cortes")
    )
    state = cutoffs.groupBy("estrato", "_estratos", "n_boas").agg(
        F.sort_array(
            F.collect_list(F.struct(F.get("cortes", F.lit(0))["n_ruins"].alias("n_ruins"), (-F.col("regra")).alias("ordem"), "cortes")), asc=False
        ).alias("por_regra")
    )
    none = F.lit(None).cast("struct<n_ruins:bigint,corte:int,n_recusadas:bigint>")
    state = state.join(choices, "estrato").withColumn("tomados", F.array(*[none] * len(regras)))
    good = alike.where("qualidade = 1").select("estrato", "niveis", "n")
    for step in range(len(regras)):
        now = F.get("por_regra", F.lit(step))
        gone = F.exists(
            F.zip_with("niveis", "tomados", lambda n, t: F.coalesce(n > t["corte"], F.lit(False))), lambda x: x
        )
        own = F.get("niveis", -now["ordem"])
        joined = state.join(good, "estrato").groupBy("estrato").agg(
            *[F.any_value(c).alias(c) for c in ("_estratos", "_parte", "n_boas", "por_regra", "tomados")],
            F.array(
                *[F.sum(F.when(gone | (own > c), F.col("n")).otherwise(0)) for c in range(len(CUTOFFS))]
            ).alias("_juntas"),
        )
        fits = F.filter(
            now["cortes"], lambda c: holds(F.get("_juntas", c["corte"]), F.col("n_boas"), error + F.col("_parte"))
        )
        state = joined.withColumn("_novo", F.get(fits, F.lit(0))).select(
            "estrato",
            "_estratos",
            "_parte",
            "n_boas",
            "por_regra",
            F.transform(
                "tomados", lambda t, i: F.when(i == -now["ordem"], F.col("_novo")).otherwise(t)
            ).alias("tomados"),
        )
    taken = state.select("estrato", "n_boas", F.posexplode("tomados").alias("_r", "t")).where("t is not null")
    return taken.select(
        "estrato",
        F.get(F.array(*map(F.lit, regras)), F.col("_r")).alias("regra"),
        "n_boas",
        F.get(F.array(*map(F.lit, CUTOFFS)), F.col("t.corte")).alias("corte"),
        "t.n_recusadas",
        "t.n_ruins",
    )


def quality_rules(
    documento: DataFrame,
    rotulo: DataFrame,
    estrato: str = "idioma",
    max_recusa: float = 0.01,
    confianca: float = 0.95,
    com_texto: bool = False,
) -> DataFrame:
    """Verdict on every row of ``documento`` (``id``, ``texto``, the column named by ``estrato``).

    ``rotulo``: the labelled holdout, ``id`` and ``qualidade`` (1 good, 0 poor). Returns
    the input columns without ``texto`` (with it if ``com_texto``), the measures ``n_palavras``, ``n_caracteres``,
    ``n_simbolos``, ``n_linhas_repetidas``, ``n_palavras_repetidas``, ``n_linhas``,
    ``n_maiusculas``, ``n_barras``, then ``reprovado_base`` (too short, or too many words
    in repeated runs), ``regras_violadas`` (sorted names) and ``mantido``. Input columns
    of these names are replaced.

    A null text is empty and fails the base rule; a null stratum counts as the empty
    string; rows of a repeated id are judged each on its own text, and count as often as
    they are labelled; labels without a document are ignored. Without enough labels in
    a stratum only the base rule rejects. Built-in functions only; texts are measured
    once, the holdout join moves measures, never texts, and what is broadcast has one row per stratum.
    """
    measured = materialise(measure(documento, com_texto), "medidas")
    labels = rotulo.select(F.col("id").alias("_id"), F.col("qualidade")).where("_id is not null")
    needed = {c for pair in RULES.values() for c in pair} | {"reprovado_base", estrato, "id"}
    holdout = measured.select(*sorted(needed)).join(labels, F.col("id") == F.col("_id"))
    cutoffs = choose_cutoffs(holdout, estrato, max_recusa, confianca)
    # Written first, so that Spark knows the size of the few rows and moves no document to them.
    wide = materialise(
        cutoffs.groupBy("estrato").agg(
            *[F.max(F.when(F.col("regra") == r, F.col("corte"))).alias(f"_corte_{r}") for r in RULES]
        ),
        "cortes",
    )
    stratum = F.coalesce(F.col(estrato).cast("string"), F.lit(""))
    judged = measured.withColumn("_estrato", stratum).join(
        wide.withColumnRenamed("estrato", "_estrato"), "_estrato", "left"
    )
    broken = F.sort_array(
        F.filter(
            F.array(*[F.when(_rate(r) > F.col(f"_corte_{r}"), F.lit(r)) for r in RULES]), lambda r: r.isNotNull()
        )
    )
    out = judged.withColumn("regras_violadas", broken)
    out = out.withColumn("mantido", ~F.col("reprovado_base") & (F.size("regras_violadas") == 0))
    return out.select(*measured.columns, "regras_violadas", "mantido")
