"""Free wording against a dictionary's rows: tokens, candidates through postings, scores, and what is decided of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.shared import written

# Thresholds and weights of the decision; words of little meaning; suffixes and spellings of the stem.
MIN_SCORE, MIN_COVERAGE, TABLE_MASS, MARGIN = 0.55, 0.60, 0.60, 0.02
COVERAGE, PRECISION, STEMMED, WEAK, AUXILIARY, CONTEXT = 0.85, 0.15, 0.85, 0.30, 0.12, 0.06
WEAK_TOKENS = "behavior behaviors behaviour behaviours problem problems symptom symptoms score scores scoring level levels measure measures measured index indices assessment assessments outcome outcomes variable variables data value values test tests task tasks scale scales subscale subscales questionnaire inventory item items version total child children youth participant participants".split()
STOP_WORDS = "the and for with from that this were was are not but has have had its their them they which who whom into over under than then each per via".split()
SUFFIXES = ["izations", "ization", "isation", "izing", "ising", "ized", "ised", "ness", "ing", "edly", "ally", "ies", "ers", "ed", "ly", "es", "s"]
SPELLING = {"behaviour": "behavior", "behaviours": "behavior", "colour": "color", "centre": "center", "grey": "gray"}
#: Candidates that the decision looks at.
TOP = 10


def tokens(text: Column) -> Column:
    """words of three letters or more but stop-words, each once, in order of first use."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS)))


def stem(token: Column) -> Column:
    """a word of six letters or more without its first suffix of the list that leaves four."""
    spelled = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SPELLING.items() for x in pair]), token), token)
    found = F.when(F.length(spelled) < 6, spelled)
    for suffix in SUFFIXES:
        found = found.when(spelled.endswith(suffix) & (F.length(spelled) - len(suffix) >= 4), F.substring(spelled, F.lit(1), F.length(spelled) - len(suffix)))
    return found.otherwise(spelled)


def release_of(stated: Column, available: Column) -> Column:
    """releases to search: the stated one, else the legacy one for 4.x and 5.x, else its major's; none means all."""
    major, minor = F.regexp_extract(F.coalesce(stated, F.lit("")), r"\b([0-9]+)\.([0-9]+)\b", 1), F.regexp_extract(F.coalesce(stated, F.lit("")), r"\b([0-9]+)\.([0-9]+)\b", 2)
    exact = F.concat(major, F.lit("."), minor)
    return (
        F.when(major == "", F.array().cast("array<string>"))
        .when(F.array_contains(available, exact), F.array(exact))
        .when(major.isin("4", "5") & F.array_contains(available, F.lit("legacy")), F.array(F.lit("legacy")))
        .otherwise(F.array_sort(F.filter(available, lambda r: r.startswith(F.concat(major, F.lit("."))))))
    )


def in_release(releases: Column, wanted: Column) -> Column:
    """Whether a row's list of releases holds the wanted one; an empty list or wish passes."""
    return F.coalesce(wanted, F.lit("")).isin("") | F.coalesce(releases, F.lit("")).isin("") | F.array_contains(F.split(F.coalesce(releases, F.lit("")), ";"), wanted)


def release_order(release: Column) -> Column:
    """What releases sort by: their numbers, so that 10.0 comes after 9.1."""
    return F.transform(F.split(release, r"\."), lambda x: F.coalesce(F.regexp_replace(x, r"\D", "").try_cast("int"), F.lit(-1)))


def dictionary(rows: DataFrame) -> DataFrame:
    """(row, name, label, table, domain, study, release) with the distinct ``tokens`` of labels and their ``stems``."""
    return rows.withColumn("tokens", tokens(F.col("label"))).withColumn("stems", F.transform("tokens", stem))


def frequencies(rows: DataFrame) -> DataFrame:
    """(token, df, idf) of a dictionary's labels, idf being ln(N / df)."""
    n = rows.agg(F.count(F.lit(1)).alias("rows"))
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return counts.join(F.broadcast(n)).select("token", "df", F.log(F.col("rows") / F.col("df")).alias("idf"))


def scores(mentions: DataFrame, rows: DataFrame, least_hits: int = 2, rare: int = 200) -> DataFrame:
    """(mention, row, ..., score, coverage) of rows that mentions (mention, text, auxiliary, context) meet.

    Postings of tokens that ``rare`` labels or fewer have propose rows; a mention without such a token is proposed the
    rows that have its two least common ones. Proposed rows are then scored over all tokens: coverage is the tokens'
    weight that the label has, a stem counting 0.85, a weak word 0.30; precision the label's share that is met.
    """
    rows = written(rows, "dictionary")
    known = frequencies(rows)
    asked = mentions.withColumn("tokens", tokens(F.col("text")))
    each = asked.select("mention", F.explode("tokens").alias("token"), F.array_size("tokens").alias("n")).join(known, "token", "left")
    most = known.agg(F.coalesce(F.max("idf"), F.lit(0.0)).alias("top"))
    weight = F.when(F.col("token").isin(*WEAK_TOKENS), WEAK).otherwise(1.0) * F.coalesce("idf", "top")
    weighed = each.join(F.broadcast(most)).select("mention", "token", stem(F.col("token")).alias("stem"), "df", weight.alias("w"), (~F.col("token").isin(*WEAK_TOKENS)).alias("strong"))
    few = F.col("stem_df") <= rare
    postings = rows.select("row", F.explode(F.array_distinct("stems")).alias("stem"))
    held = postings.groupBy("stem").agg(F.count(F.lit(1)).alias("stem_df"))
    known_stems = weighed.select("mention", "stem").distinct().join(held, "stem")
    place = F.row_number().over(Window.partitionBy("mention").orderBy("stem_df", "stem"))
    probes = known_stems.withColumn("k", place).withColumn("any", F.max(few).over(Window.partitionBy("mention"))).where(few | (~F.col("any") & (F.col("k") <= 2)))
    needed = probes.groupBy("mention").agg(F.when(F.bool_or("any"), 1).otherwise(F.count(F.lit(1))).alias("needed"))
    met = probes.select("mention", "stem").join(postings, "stem").groupBy("mention", "row").agg(F.count(F.lit(1)).alias("got"))
    proposed = met.join(needed, "mention").where("got >= needed").select("mention", "row")
    labels = rows.select("row", "name", "label", "table", "domain", "study", "release", F.col("tokens").alias("label_tokens"), F.col("stems").alias("label_stems"))
    query = weighed.groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("token", "stem", "w", "strong"))).alias("q"), F.sum("w").alias("total"), F.count_if("strong").alias("strong"))
    pairs = proposed.join(query, "mention").join(labels, "row").join(mentions.select("mention", tokens(F.col("auxiliary")).alias("aux"), tokens(F.col("context")).alias("ctx")), "mention")
    exact = lambda x: F.array_contains("label_tokens", x["token"])
    hit = lambda x: exact(x) | F.array_contains("label_stems", x["stem"])
    credit = F.aggregate("q", F.lit(0.0), lambda a, x: a + F.when(exact(x), x["w"]).when(hit(x), x["w"] * STEMMED).otherwise(0.0))
    met = F.filter("q", hit)
    aux = F.when(F.size("aux") > 0, F.size(F.array_intersect("aux", "label_tokens")) / F.size("aux")).otherwise(0.0)
    extra = F.size(F.array_except(F.array_intersect("ctx", "label_tokens"), F.transform("q", lambda x: x["token"])))
    found = pairs.select("mention", "row", "name", "table", "domain", "study", "release", F.try_divide(credit, F.col("total")).alias("coverage"), (F.size(met) / F.greatest(F.size("label_tokens"), F.lit(1))).alias("precision"), F.size(F.filter(met, lambda x: x["strong"])).alias("hits"), "strong", aux.alias("aux"), extra.alias("extra"))
    found = found.where(F.col("hits") >= F.least(F.lit(least_hits), F.greatest("strong", F.lit(1))))
    score = COVERAGE * F.col("coverage") + PRECISION * F.col("precision") + AUXILIARY * F.col("aux") + F.least(F.lit(CONTEXT), 0.02 * F.col("extra"))
    return found.select("mention", "row", "name", "table", "domain", "study", "release", F.round(score, 6).alias("score"), F.round("coverage", 6).alias("coverage"))


# Weights of what wordings and names tell; tokens from which a question is long; what the names of items, of
# answers that were not given and of a respondent's variables end in or hold; what labels of administration say; how labels
# and papers word a metric, and a respondent.
RESPONDENT, OTHER_RESPONDENT, METRIC, OTHER_METRIC = 0.10, -0.18, 0.08, -0.05
ADMINISTRATION, UNASKED, ITEM, QUESTION, LONG_QUESTION = -0.22, -0.06, -0.10, -0.18, -0.20
LONG_TOKENS = 12
ITEM_NAME = r"___\d+$|_q\d+$|_\d{1,3}$"
NO_ANSWER_NAME = r"_(?:dk|nr|refuse[d]?|na)$"
ADMINISTRATION_LABEL = (
    r"(?i)\bversion\b|\blanguage\b|\bitmcnt\b|\bitem count\b|\btheta\b|date ?finished|date and time|\btimestamp\b|administ\w*|"
    r"number (?:of )?(?:miss\w*|answer\w*|valid\w*|item\w*|total\w*|question\w*)|number with|\bmissing\b|complete\?|completed\?|"
    r"\bvalidity\b|\bqc\b|quality control|\bflags?\b|\bissues?\b|\badmin\b|don'?t know|no lo s|\brefus\w*|prefer not to|decline[ds]? to answer"
)
LABEL_METRICS = {"fully_corrected": r"fully[\s-]*corrected|\bfc\b", "age_corrected": r"age[\s-]*corrected", "uncorrected": r"uncorrected", "t_score": r"t[\s-]*scores?\b|tscore", "percentile": r"percentile", "prorated": r"prorated", "raw": r"\braw\b", "sum": r"\bsum\b|\btotal\b", "mean": r"\bmean\b|\baverage\b", "z_score": r"\bz[\s-]*scores?\b|standardi[sz]ed", "computed": r"computed"}
PAPER_METRICS = {"fully_corrected": r"fully[\s-]*corrected", "age_corrected": r"age[\s-]*corrected|age[\s-]*adjusted", "uncorrected": r"uncorrected", "t_score": r"t[\s-]*scores?\b", "percentile": r"percentile", "prorated": r"prorated", "raw": r"\braw\s+scores?\b", "sum": r"\bsum\s+scores?\b|\btotal\s+scores?\b|\bsum\s+of\b", "mean": r"\bmean\b|\baverage\b", "z_score": r"\bz[\s-]*scores?\b|standardi[sz]ed"}
QUALIFIERS = ["prorated", "percentile", "theta", "computed"]
LABEL_RESPONDENTS = {"parent": r"\[parent\]|\bparent(?:al)?[\s-]*report|\bcaregiver\b|\bparent\b", "youth": r"\[youth\]|\byouth[\s-]*report|\bchild[\s-]*report|\bself[\s-]*report|\byouth\b", "teacher": r"\bteacher\b"}
NAME_RESPONDENTS = {"parent": r"_p(?:_|$)", "youth": r"_y(?:_|$)"}
PAPER_RESPONDENTS = {"parent": r"\bparent(?:s|al|ing)?[\s-]*(?:report|rated|reported|version)?\b|\bcaregiver\b|\bprimary caregiver\b", "youth": r"\byouth[\s-]*(?:report|rated|reported)?\b|\bchild(?:ren)?[\s-]*(?:report|rated|reported|completed)\b|\bself[\s-]*report\b|\badolescent[\s-]*report\b", "teacher": r"\bteacher[\s-]*(?:report|rated|reported)?\b"}


def _named(text: Column, patterns: dict[str, str]) -> Column:
    """All names whose pattern a text holds."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){rx}"), F.lit(name)) for name, rx in patterns.items()]))


def _first_named(text: Column, patterns: dict[str, str]) -> Column:
    return F.get(_named(text, patterns), 0)


def _sole_named(text: Column, patterns: dict[str, str]) -> Column:
    """What one pattern alone names: a wording that names several says nothing."""
    found = _named(text, patterns)
    return F.when(F.size(found) == 1, F.get(found, 0))


def row_cues(rows: DataFrame) -> DataFrame:
    """(row, respondent, metrics, penalty, question): what a dictionary row's name and label tell, typed.

    penalty is for names of items and labels of administration; question is what a label that is a question loses, more
    the longer it is, unless a mention is a question too.
    """
    name, label = F.coalesce("name", F.lit("")), F.coalesce("label", F.lit(""))
    n = F.size("tokens")
    long = F.least(F.lit(1.0), (n - LONG_TOKENS) / LONG_TOKENS) * LONG_QUESTION
    asks = F.regexp_replace(label, r"\s+$", "").endswith("?")
    respondent = F.coalesce(_first_named(label, LABEL_RESPONDENTS), _first_named(F.lower(name), NAME_RESPONDENTS))
    penalty = F.when(name.rlike(ITEM_NAME), ITEM).otherwise(0.0) + F.when(label.rlike(ADMINISTRATION_LABEL) | name.rlike(NO_ANSWER_NAME), ADMINISTRATION).otherwise(0.0)
    question = F.when(asks, QUESTION + F.when(n > LONG_TOKENS, long).otherwise(0.0)).otherwise(0.0)
    return rows.select("row", respondent.alias("respondent"), _named(label, LABEL_METRICS).alias("metrics"), penalty.alias("penalty"), question.alias("question"))


def mention_cues(mentions: DataFrame) -> DataFrame:
    """(mention, wanted, asked, is_question): the respondent that a paper names, in the wording before the context, its metrics, and whether it asks."""
    text = F.concat_ws(" ", "text", F.nullif("auxiliary", F.lit("")))
    context = F.coalesce("context", F.lit(""))
    stated = [F.nullif("respondent", F.lit(""))] if "respondent" in mentions.columns else []
    wanted = F.coalesce(*stated, _sole_named(text, PAPER_RESPONDENTS), _sole_named(context, PAPER_RESPONDENTS))
    return mentions.select("mention", wanted.alias("wanted"), _named(F.concat(text, F.lit(" "), context), PAPER_METRICS).alias("asked"), F.coalesce(F.col("text").contains("?"), F.lit(False)).alias("is_question"))


def cued(found: DataFrame, mentions: DataFrame, rows: DataFrame) -> DataFrame:
    """scores with all that wordings and names tell of respondent, metric, administration, item, question, length and qualifier.

    ``found`` of scores has the four terms of words; cues are taken once a row and once a mention and met where both are.
    """
    both = found.join(row_cues(rows), "row").join(mention_cues(mentions), "mention")
    who = F.when(F.col("respondent") == F.col("wanted"), RESPONDENT).when(F.col("respondent") != F.col("wanted"), OTHER_RESPONDENT).otherwise(0.0)
    metric = F.when(F.size("asked") == 0, 0.0).when(F.arrays_overlap("asked", "metrics"), METRIC).when(F.size("metrics") > 0, OTHER_METRIC).otherwise(0.0)
    unasked = F.exists("metrics", lambda m: m.isin(*QUALIFIERS) & ~F.array_contains("asked", m))
    terms = who + metric + F.col("penalty") + F.when(F.col("is_question"), 0.0).otherwise(F.col("question")) + F.when(unasked, UNASKED).otherwise(0.0)
    return both.withColumn("score", F.round(F.col("score") + terms, 6)).select(*found.columns)


def merged_releases(found: DataFrame) -> DataFrame:
    """One candidate a study and variable: the best of its releases, with the list of them."""
    best = F.max_by(F.struct("table", "domain", "score", "coverage"), F.struct("score", -F.col("row"))).alias("x")
    return found.groupBy("mention", "study", "name").agg(best, F.array_join(F.array_sort(F.collect_set("release")), ",").alias("releases")).select("mention", "study", "name", "releases", "x.*")


def common_prefix(names: Column) -> Column:
    """The longest start, in parts between underscores, that all names share, with ``_*``; null if none."""
    parts = F.transform(names, lambda n: F.split(n, "_"))
    shortest = F.array_min(F.transform(parts, lambda p: F.size(p)))
    same = lambda k: F.forall(parts, lambda p: F.slice(p, 1, k) == F.slice(F.get(parts, 0), 1, k))
    held = F.filter(F.sequence(shortest, F.lit(1), F.lit(-1)), same)
    return F.when((F.size(names) > 0) & (F.size(held) > 0), F.concat(F.array_join(F.slice(F.get(parts, 0), 1, F.get(held, 0)), "_"), F.lit("_*")))


def decided(found: DataFrame) -> DataFrame:
    """What the candidates of a mention (mention, name, table, domain, score, coverage) say.

    Of those above the thresholds the TOP by score, then name, vote with their scores: a table with 0.60 of the mass names
    a variable, or, where the best two are within 0.02, a family; all one variable names it without a table; a domain
    with 0.60 of the mass is named alone; else the mention is ambiguous.
    """
    # Candidates are scored once and read from there by every vote.
    kept = written(found.where((F.col("score") >= MIN_SCORE) & (F.col("coverage") >= MIN_COVERAGE)).select("mention", "name", "table", "domain", "score"), "candidates")
    place = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "name", "table"))
    top = kept.withColumn("k", place).where(F.col("k") <= TOP)
    whole = top.groupBy("mention").agg(F.sum("score").alias("total"), F.count_distinct("name").alias("names"), F.min_by("name", "k").alias("first"), F.max("score").alias("best"))
    mass = lambda keys: top.groupBy("mention", *keys).agg(F.sum("score").alias("mass"), F.min("k").alias("k")).groupBy("mention").agg(F.max_by(F.struct(*keys, "mass"), F.struct("mass", -F.col("k"))).alias("x"))
    tables = mass(["table", "domain"]).select("mention", F.col("x.table").alias("table"), F.col("x.domain").alias("table_domain"), F.col("x.mass").alias("table_mass"))
    domains = mass(["domain"]).select("mention", F.col("x.domain").alias("domain"), F.col("x.mass").alias("domain_mass"))
    own = kept.join(tables, ["mention", "table"]).where("domain <=> table_domain")
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "name")))
    winner = ranked.where("k = 1").select("mention", F.col("name").alias("winner"), F.col("score").alias("win"))
    rivals = ranked.join(winner, "mention").where("name != winner").groupBy("mention").agg(F.max("score").alias("rival"))
    family = ranked.groupBy("mention").agg(F.count(F.lit(1)).alias("family_size"), F.array_sort(F.collect_set("name")).alias("family"))
    joined = whole.join(tables, "mention").join(domains, "mention").join(winner, "mention", "left").join(rivals, "mention", "left").join(family, "mention", "left")
    sure = F.col("table_mass") / F.col("total") >= TABLE_MASS
    close = F.col("rival").isNotNull() & (F.round(F.col("win") - F.col("rival"), 6) < MARGIN)
    status = (
        F.when(sure & ~close, "variable")
        .when(sure, "family")
        .when(F.col("names") == 1, "variable")
        .when(F.col("domain").isNotNull() & (F.col("domain_mass") / F.col("total") >= TABLE_MASS), "domain")
        .otherwise("ambiguous")
    )
    variable = F.when(status == "variable", F.when(sure, F.col("winner")).otherwise(F.col("first")))
    table = F.when(sure, F.col("table"))
    return joined.select("mention", status.alias("status"), variable.alias("variable"), table.alias("table"), F.when(status == "family", F.col("family_size")).alias("family_size"), F.when(status == "family", common_prefix(F.col("family"))).alias("family_prefix"), F.when(status == "domain", F.col("domain")).alias("domain"))


# Words that make a phrase the name of an instrument.
INSTRUMENT = r"(?i)\b(scales?|subscales?|checklists?|inventor(?:y|ies)|questionnaires?|interviews?|tests?|tasks?|toolbox|batter(?:y|ies)|surveys?|schedules?|screeners?|forms?|reports?|assessments?|indices|examinations?|protocols?|diagnostic|instruments?)\b"


def instruments(rows: DataFrame) -> DataFrame:
    """(instrument, table, rows, tables, acronym) of the heads of labels that name one: its table with most rows."""
    head = F.trim(F.regexp_extract("label", r"^([^\[(:]*)", 1), F.lit(" ,-;"))
    named = rows.withColumn("head", head).where(F.length("head").between(12, 90) & F.col("head").rlike(INSTRUMENT))
    key = F.trim(F.regexp_replace(F.lower("head"), "[^a-z0-9]+", " "))
    acronym = F.array_join(F.transform(F.regexp_extract_all("head", F.lit(r"(?<![A-Za-z])[A-Z]"), F.lit(0)), lambda c: c), "")
    counts = named.select(key.alias("instrument"), acronym.alias("acronym"), "table").groupBy("instrument", "table").agg(F.count(F.lit(1)).alias("n"), F.min("acronym").alias("acronym"))
    found = counts.groupBy("instrument").agg(F.min(F.struct((-F.col("n")).alias("least"), "table")).alias("x"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("tables"), F.min("acronym").alias("acronym"))
    return found.select("instrument", F.col("x.table").alias("table"), "rows", "tables", F.when(F.length("acronym").between(3, 8), F.col("acronym")).alias("acronym"))


def acronyms(found: DataFrame) -> DataFrame:
    """Acronyms of one instrument only, with it."""
    return found.where("acronym is not null").groupBy("acronym").agg(F.count_distinct("instrument").alias("n"), F.min("instrument").alias("instrument")).where("n = 1").drop("n")
