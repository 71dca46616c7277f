"""Two-level topics and what is derived from them: crawls, labels, balanced choices, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.plans.lineage import broadcast_if_few

# The taxonomy, general topics in label order with role, broader topic and
# their subtopics; phrases are the names but for those given.
GENERALS = {
    "physics": ("domain", "science", ("quantum_mechanics", "relativity", "astrophysics", "classical_mechanics")),
    "biology": ("domain", "science", ("genetics", "evolution", "cell_biology", "ecology")),
    "chemistry": ("domain", "science", ("organic_chemistry", "chemical_reactions", "periodic_table")),
    "technology": ("domain", None, ("quantum_computing", "artificial_intelligence", "software", "hardware")),
    "science": ("domain", None, ("scientific_method", "history_of_science", "scientific_research")),
    "books": ("format", None, ("novels", "science_books", "poetry", "authors")),
    "sports": ("domain", None, ("football", "basketball", "olympics")),
    "history": ("domain", None, ("ottoman_history", "world_wars", "ancient_history")),
}
PHRASES = {
    "relativity": "theory of relativity",
    "periodic_table": "periodic table of elements",
    "hardware": "computer hardware",
    "science_books": "popular science books",
    "authors": "authors and writers",
    "football": "association football",
    "olympics": "Olympic Games",
    "ottoman_history": "Ottoman Empire history",
    "world_wars": "World War I and World War II",
}
# Names that are not the identifier with capitals.
NAMES = {"history_of_science": "History of Science", "football": "Football (Soccer)"}
PERSPECTIVES = {"history": "history of {topic}"}


# Category names that no crawl goes through, those of people and bodies, and those of single subtopics.
EXCLUDED_EVERYWHERE = (
    "(?i)stubs?$", "(?i)(^|_)lists?(_|$)", "(?i)templates?", "(?i)wikipedia", "(?i)(^|_)images?(_|$)", "(?i)video_games",
    "(?i)(^|_)portals?(_|$)", "(?i)redirects?", "(?i)disambiguation", "(?i)hidden_categories", "(?i)articles_", "(?i)^works_by_",
    "(?i)_logos?$", "(?i)(^|_)people(_|$)", "(?i)popular_culture", "(?i)fiction",
    "(?i)(^|_)(films?|songs?|albums?|television|anime|manga)(_|$)", "(?i)(^|_)(awards?|prizes?)(_|$)", "(?i)recipients_of",
)
EXCLUDED_GROUPS = {
    "science_person": (
        "(?i)(physicists|chemists|biologists|geneticists|ecologists|astronomers|astrophysicists|mathematicians|scientists|engineers|"
        "researchers|inventors|people|alumni|awards|prizes|laureates|medalists|academic_journals|journals|periodicals|institutes|"
        "organizations|organisations|companies|societies|museums|universities|laboratories|conferences|fictional|in_fiction|"
        "in_popular_culture|films|television|songs|albums|games|toys)",
    ),
}
EXCLUDED_OF = {
    "quantum_mechanics": ("(?i)quantum_information|quantum_computing|quantum_cryptograph",),
    "relativity": ("(?i)critics|^Dimension$",),
    "classical_mechanics": ("(?i)acoustic|(^|_)sound|noise|audio|music|hearing|loudspeaker|microphone",),
    "periodic_table": ("(?i)predicted_by",),
    "quantum_computing": ("(?i)post-quantum|companies",),
    "artificial_intelligence": ("(?i)(^|_)art$|artificial_intelligence_art|conferences|competitions|publications|deaths|existential_risk|regulation",),
    "scientific_method": ("(?i)techniques|data_analysis|heuristics|religion|dating_methods|evidence-based|hypotheses", "(?i)^research_methods$|scientific_observation"),
    "history_of_science": ("(?i)by_discipline|natural_history|naturalist|hoax|romantic|librar|museum|expedition|instrument|timeline|measurement|genealog|defunct|former_|books|works_about|organizations",),
    "science_books": ("(?i)psychology|social_sciences",),
    "poetry": ("(?i)organizations|publishers|museums|festivals|houses|depictions|characters|aviation",),
    "world_wars": ("(?i)cultural|media|works_about|(^|_)(art|arts|music|literature|memorials?)(_|$)|controversies", "(?i)science_and_technology_during"),
    "ancient_history": ("(?i)^historians_of",),
}
# The general topics whose subtopics leave out people and bodies, and names of pages that are no articles.
WITHOUT_PEOPLE = ("physics", "biology", "chemistry", "technology", "science")
NO_ARTICLE = r"^Category:|^(List|Lists|Index|Outline|Timeline|Glossary)_of_|\(disambiguation\)"


class TaxonomyError(ValueError):
    """A taxonomy that is not one."""


def taxonomy_rows(generals: dict = GENERALS) -> list[tuple]:
    """(general_ix, general, role, broader, sub_ix, subtopic, phrase), checked."""
    rows, seen, n = [], set(), 0
    for g, (name, (role, broader, subs)) in enumerate(generals.items()):
        if role not in ("domain", "format"):
            raise TaxonomyError(f"{name}: role {role}")
        if broader is not None and broader not in generals:
            raise TaxonomyError(f"{name}: unknown broader topic {broader}")
        for sub in subs:
            if sub in seen:
                raise TaxonomyError(f"subtopic {sub} comes twice")
            seen.add(sub)
            rows.append((g, name, role, broader, n, sub, PHRASES.get(sub, sub.replace("_", " "))))
            n += 1
    return rows


def taxonomy(spark: SparkSession, generals: dict = GENERALS) -> DataFrame:
    """The taxonomy as a dimension table; a fixed number of rows, so it may be broadcast."""
    return spark.createDataFrame(taxonomy_rows(generals), "general_ix int, general string, role string, broader string, sub_ix int, subtopic string, phrase string")


def parents() -> list[int]:
    """The general topic's place of each subtopic, in label order."""
    return [r[0] for r in taxonomy_rows()]


def subtopic_list(column: str | Column) -> Column:
    """'a|b' as a sorted array; null and '' as an empty one."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_sort(F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != ""))


def is_consistent(general: Column, subs: Column, generals: dict = GENERALS) -> Column:
    """Whether all subtopics are children of the general topic; null for an unknown one."""
    children = F.create_map(*(x for g, (_, _, s) in generals.items() for x in (F.lit(g), F.array(*map(F.lit, s)))))
    return F.size(F.array_except(subs, F.try_element_at(children, general))) == 0


def encode_general(general: Column, generals: dict = GENERALS) -> Column:
    """0-based place in label order; null if unknown."""
    return F.try_element_at(F.create_map(*(x for i, g in enumerate(generals) for x in (F.lit(g), F.lit(i)))), general)


def encode_subtopics(subs: Column, generals: dict = GENERALS) -> Column:
    """0/1 for each subtopic in label order."""
    return F.array(*(F.array_contains(subs, s).cast("int") for _, _, group in generals.values() for s in group))


def exclusions(generals: dict = GENERALS, everywhere: tuple = EXCLUDED_EVERYWHERE, own: dict = EXCLUDED_OF, groups: dict | None = None) -> list[tuple[str, str]]:
    """(subtopic, pattern): the union of the patterns for all, for a subtopic, and for the named groups it leaves out.

    groups: subtopic -> names in EXCLUDED_GROUPS; by default those of WITHOUT_PEOPLE.
    """
    if groups is None:
        groups = {s: ("science_person",) for g in WITHOUT_PEOPLE if g in generals for s in generals[g][2]}
    every = [s for _, _, subs in generals.values() for s in subs]
    return [(s, p) for s in every for p in dict.fromkeys((*everywhere, *own.get(s, ()), *(p for n in groups.get(s, ()) for p in EXCLUDED_GROUPS[n])))]


def is_article(name: Column) -> Column:
    """Whether a page's name, blanks as underscores, is that of an article: no category, list, index or disambiguation."""
    return ~name.rlike(NO_ARTICLE)


def membership_statistics(membership: DataFrame, deepest: int = 2) -> DataFrame:
    """(subtopic, articles, depth_0, ...): how many titles each subtopic reaches, and at which least depth."""
    least = membership.groupBy("title", "subtopic").agg(F.min("depth").alias("depth"))
    return least.groupBy("subtopic").agg(F.count("*").alias("articles"), *(F.count(F.when(F.col("depth") == k, 1)).alias(f"depth_{k}") for k in range(deepest + 1)))


def crawl(edges: DataFrame, seeds: DataFrame, depth: int, exclude: str | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """(seed, node, depth, excluded): nodes reached from each seed over (parent, child) edges, at their least depth.

    Breadth first, at most `depth` steps (each one join and one aggregate, no collecting).
    A node whose name matches `exclude`, or a pattern of its seed in `patterns` (seed,
    pattern), is recorded and not expanded; seeds are never tested. Cycles and repeated
    edges do no harm. patterns: a dimension, a list for each seed.
    """
    named = F.col("node").rlike(exclude) if exclude else F.lit(False)
    if patterns is not None:
        own = broadcast_if_few(patterns.groupBy("seed").agg(F.collect_set("pattern").alias("_patterns")))
        named = named | F.exists(F.coalesce("_patterns", F.array().cast("array<string>")), lambda p: F.rlike("node", p))
    found = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("excluded")).distinct()
    level = found
    for step in range(1, depth + 1):
        reached = level.where(~F.col("excluded")).join(edges.select(F.col("parent").alias("node"), "child"), "node").select("seed", F.col("child").alias("node")).distinct()
        new = reached.join(found, ["seed", "node"], "left_anti")
        if patterns is not None:
            new = new.join(own, "seed", "left")
        level = new.select("seed", "node", F.lit(step).alias("depth"), named.alias("excluded"))
        found = found.unionByName(level)
    return found


def assign_labels(membership: DataFrame, dim: DataFrame, deepest: int = 1) -> DataFrame:
    """(title, general, subtopics, depth, ambiguous) from (title, subtopic, depth).

    The general topic with the least depth wins; if several share it the title is
    ambiguous and has null labels. Subtopics of the winner count at the least depth or at
    most `deepest`. One shuffle by title.
    """
    best = membership.groupBy("title", "subtopic").agg(F.min("depth").alias("depth")).join(F.broadcast(dim.select("subtopic", "general")), "subtopic")
    own = best.groupBy("title", "general").agg(F.min("depth").alias("g_depth"), F.collect_list(F.struct("subtopic", "depth")).alias("subs"))
    per = own.groupBy("title").agg(F.min("g_depth").alias("depth"), F.collect_list(F.struct("general", "g_depth", "subs")).alias("all"))
    winners = F.filter("all", lambda g: g["g_depth"] == F.col("depth"))
    single = F.size("winners") == 1
    kept = F.transform(F.filter(F.col("winners")[0]["subs"], lambda s: (s["depth"] == F.col("depth")) | (s["depth"] <= deepest)), lambda s: s["subtopic"])
    return per.withColumn("winners", winners).select("title", F.when(single, F.col("winners")[0]["general"]).alias("general"), F.when(single, F.array_sort(kept)).alias("subtopics"), "depth", (~single).alias("ambiguous"))


def select_balanced(labelled: DataFrame, membership: DataFrame, cap: int, exclude: DataFrame | None = None) -> DataFrame:
    """The titles that are among the first `cap` of some of their subtopics, by depth there, then SHA-1 of the title."""
    one = labelled if exclude is None else labelled.join(exclude.select("title").distinct(), "title", "left_anti")
    each = one.select("title", F.explode("subtopics").alias("subtopic")).join(membership.groupBy("title", "subtopic").agg(F.min("depth").alias("depth")), ["title", "subtopic"])
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("subtopic").orderBy("depth", F.sha1("title"), "title")))
    return ranked.where(F.col("n") <= cap).select("title").distinct()


def assign_splits(articles: DataFrame, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """`articles` (title, general, subtopics) with `split`, stratified by general topic and first subtopic.

    In a stratum of n >= 3 titles, in the order of their SHA-1, the first round(n * test)
    (half to even, at least 1) are test, then as many val; smaller ones are train.
    """
    # Rank and size come from one sort, and the size is added by a join, so a large stratum is never buffered whole.
    stratum = ["general", "first"]
    keyed = articles.withColumn("first", F.col("subtopics")[0])
    sizes = keyed.groupBy(*(F.col(c).alias(f"_{c}") for c in stratum)).agg(F.count("*").alias("n"))
    ranked = keyed.withColumn("i", F.row_number().over(Window.partitionBy(*stratum).orderBy(F.sha1("title"), "title")))
    joined = ranked.join(F.broadcast(sizes), F.col("general").eqNullSafe(F.col("_general")) & F.col("first").eqNullSafe(F.col("_first"))).select(*articles.columns, "i", "n")
    n_test, n_val = (F.when(F.col("n") >= 3, F.greatest(F.lit(1), F.bround(F.col("n") * f, 0).cast("int"))).otherwise(0) for f in (test, val))
    split = F.when(F.col("i") <= n_test, "test").when(F.col("i") <= n_test + n_val, "val").otherwise("train")
    return joined.withColumn("split", split).drop("i", "n")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end of the interval of a share, 4 decimals; (0, 0) if n is 0."""
    p, q = k / n, z * z / n
    middle, half = (p + q / 2) / (1 + q), z * F.sqrt(p * (1 - p) / n + q / (4 * n)) / (1 + q)
    return tuple(F.when(n == 0, 0.0).otherwise(F.round(e, 4)) for e in (middle - half, middle + half))
