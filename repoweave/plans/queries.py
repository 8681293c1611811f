"""Every operator as a query over the test tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoweave.functions import comments, fixed, paths, sniff, summary
from repoweave.functions import redaction as R
from repoweave.operators import (
    aggregate, budget, detect, gitignore, rank, redact, render, score, select,
)
from repoweave.operators.facts import facts
from repoweave.plans import flow
from repoweave.plans.options import PackOptions
from repoweave.sources import corpus, sample
from repoweave.sources.scratch import written

KEY = ["repo_id", "path"]
Query = Callable[[SparkSession, str], DataFrame]

# Options that the sample repositories are large enough to feel.
AUTO = PackOptions.preset("auto", as_of=sample.AS_OF)
INFRA = PackOptions.preset("infra", as_of=sample.AS_OF)
TOKENS = PackOptions.preset("auto", token_limit_chars=60_000, as_of=sample.AS_OF)
RECENT = PackOptions(recent_days=30, as_of=sample.AS_OF)
SMALL_FILES = PackOptions.preset("code", max_file_bytes=4_000, as_of=sample.AS_OF)
USER_LISTS = PackOptions(
    extensions=(".py", ".md"), files=("LICENSE",), auto_detect=True, as_of=sample.AS_OF
)
USER_IGNORE = PackOptions(ignore=("notes/**", "**/k8s*/**"))
FILE_CAP, PRIORITY_CAP = 30, 20
CAPPED = PackOptions.preset("code", max_files=20, as_of=sample.AS_OF)
SMALL_TOKENS = PackOptions.preset("auto", token_limit_chars=20_000, as_of=sample.AS_OF)
STRICT = PackOptions.preset("auto", security="strict", as_of=sample.AS_OF)
TREE = PackOptions.preset("code", tree=True, as_of=sample.AS_OF)

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def over_files(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(sample.files(spark, sf_dir))


def over_facts(name: str, build: Callable[[DataFrame], DataFrame], opts: PackOptions = AUTO) -> None:
    over_files(name, lambda files: build(facts(files, opts)))


def over_labels(name: str, build: Callable[[DataFrame, PackOptions], DataFrame], opts: PackOptions = AUTO) -> None:
    """A query over the labelled facts, under the ignore rules of the repositories."""
    QUERIES[name] = lambda spark, sf_dir: build(
        flow.labelled(sample.files(spark, sf_dir), opts, rule_sets(spark, sf_dir)), opts
    )


def over_flow(name: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """A query over the files and the rule sets of the repositories."""
    QUERIES[name] = lambda spark, sf_dir: build(sample.files(spark, sf_dir), rule_sets(spark, sf_dir))


def rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gitignore.rule_sets(sample.gitignore_files(spark, sf_dir))


def with_time_text(files: DataFrame) -> DataFrame:
    return files.withColumn("mtime", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss"))


# -------------------------------------------------------- sources and sinks ----
over_files("scan_files", lambda f: with_time_text(f).select(
    *KEY, "size", "mtime", F.length("content").cast("bigint").alias("chars")))
over_files("scan_stats", lambda f: with_time_text(corpus.scan_stats(f)))
over_files("read_text", lambda f: corpus.read_text(f).select(*KEY, "content", "is_valid_utf8"))


def damaged(files: DataFrame) -> DataFrame:
    """The files as bytes, with a byte that is no UTF-8 after the text where the size is a multiple of 7."""
    extra = F.when(F.col("size") % 7 == 0, F.lit(b"\xff")).otherwise(F.lit(b""))
    return files.withColumn("bytes", F.concat(F.col("content").cast("binary"), extra))


over_files("read_text_invalid", lambda f: corpus.read_text(damaged(f)).select(*KEY, "content", "is_valid_utf8"))


@query
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gitignore.ignore_rules(sample.gitignore_files(spark, sf_dir))


# ------------------------------------------------- path and size projections ----
over_files("path_parts", lambda f: f.select(
    *KEY, paths.basename().alias("base"), paths.dirname().alias("dir"),
    paths.extname().alias("ext"), paths.lower_ext().alias("lower_ext")))
over_files("token_estimate", lambda f: f.select(
    *KEY, paths.token_estimate("size").alias("size_tokens"),
    paths.token_estimate(F.length("content").cast("bigint")).alias("char_tokens")))
over_files("human_size", lambda f: f.select(
    *KEY, paths.human_size().alias("shown_size"),
    paths.human_size(F.col("size") * 997).alias("shown_large"),
    paths.human_size(F.col("size") * 1_234_567).alias("shown_huge")))
over_files("file_flags", lambda f: f.select(
    *KEY, *[c.alias(n) for n, c in paths.file_flags().items()]))
over_files("language_id", lambda f: f.select(*KEY, paths.language_id().alias("language")))
over_files("type_group", lambda f: f.select(*KEY, paths.type_group().alias("type_group")))

# -------------------------------------------------------------------- filters ----
over_files("filter_ignore_dirs", lambda f: f.where(~select.in_ignored_directory(USER_IGNORE)).select(*KEY))
over_files("filter_exclude_exact", lambda f: f.where(~select.is_excluded_exactly()).select(*KEY))
over_files("filter_exclude_glob", lambda f: f.where(~select.is_excluded_by_glob()).select(*KEY))
over_files("filter_include_name", lambda f: f.where(select.has_include_name()).select(*KEY))
over_files("filter_special_substring", lambda f: f.where(select.has_special_name()).select(*KEY))
over_files("filter_high_priority", lambda f: f.where(paths.is_high_priority()).select(*KEY))
over_files("filter_entry_point", lambda f: f.where(paths.is_entry_point()).select(*KEY))
over_files("filter_important_folder", lambda f: f.where(
    paths.in_important_folder() & select.has_extension()).select(*KEY))
over_files("filter_extension", lambda f: f.where(select.has_extension()).select(*KEY))
over_facts("filter_fallback_sniff", lambda f: f.where("looks_like_code").select(*KEY))
over_files("filter_recent", lambda f: f.where(select.is_recent(RECENT)).select(*KEY))
over_flow("filter_gitignore", lambda f, rules: gitignore.with_ignored(
    f.select(*KEY), rules).where(~F.col("is_gitignored")).select(*KEY))
over_files("filter_binary", lambda f: f.where(~paths.is_binary()).select(*KEY))
over_files("filter_size", lambda f: f.where(select.fits_file_limit(SMALL_FILES)).select(*KEY))
over_files("code_likeness", lambda f: f.select(
    *KEY, sniff.code_like_name().alias("by_name"), sniff.code_like_content().alias("by_content"),
    sniff.mostly_printable().alias("by_characters"), sniff.looks_like_code().alias("looks_like_code")))
over_files("sensitive_paths", lambda f: f.where(paths.is_sensitive_path()).select(*KEY))
over_files("render_skip", lambda f: f.where(paths.is_render_skipped()).select(*KEY))
over_labels("select_files", lambda l, o: l.select(*KEY, "reason", "selected"))
over_labels("select_files_infra", lambda l, o: l.select(*KEY, "reason", "selected"), INFRA)
over_labels("select_files_recent", lambda l, o: l.select(*KEY, "reason", "selected"), RECENT)
over_labels("select_files_user_lists", lambda l, o: l.select(*KEY, "reason", "selected"), USER_LISTS)


# ---------------------------------------------------------------------- joins ----
@query
def exclude_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sample.files(spark, sf_dir).select(*KEY)
    return select.without_excluded(files, select.excluded_names(spark)).select(*KEY)


@query
def gitignore_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = gitignore.rule_sets(sample.gitignore_files(spark, sf_dir, sample.varied_gitignore()))
    return gitignore.with_ignored(sample.files(spark, sf_dir).select(*KEY), rules)


over_flow("gitignore_join", lambda f, rules: gitignore.with_ignored(f.select(*KEY), rules))
over_flow("survivor_content", lambda f, rules: flow.with_content(
    budget.size_budget(flow.eligible(f, AUTO, rules), AUTO).select(*KEY, "size"), f).select(*KEY, "content"))

# --------------------------------------------------------------- aggregations ----
over_files("repo_totals", lambda f: aggregate.repo_totals(f))
over_facts("detect_repo_type", lambda f: detect.has_any_type(detect.detect_repo_type(f)))
over_files("by_directory", aggregate.by_directory)
over_files("by_type", aggregate.by_type)
over_files("directory_levels", aggregate.directory_levels)
over_files("directory_tree", aggregate.directory_tree)


def deeper(files: DataFrame) -> DataFrame:
    """The files two directories further down, of which there are 3 and 8 by size, one of them hidden."""
    area = F.concat(F.lit("area"), F.pmod("size", F.lit(3)).cast("string"))
    part = F.concat(F.element_at(F.array(*map(F.lit, [".p", "p", "p-", "q", "r", "s", "t", "u"])), F.pmod("size", F.lit(8)).cast("int") + 1))
    return files.select("repo_id", F.concat_ws("/", area, part, "path").alias("path"))


over_flow("directory_tree_deep", lambda f, rules: aggregate.directory_tree_deep(
    deeper(gitignore.with_ignored(f.select(*KEY, "size"), rules).where(~F.col("is_gitignored")))))
over_files("findings_by_file", lambda f: aggregate.findings_by_file(redact.findings_table(redact.redact(f))))
over_files("findings_total", lambda f: aggregate.findings_total(redact.redact(f)))
over_files("findings_report", lambda f: aggregate.findings_report(redact.findings_table(redact.redact(f))))
over_labels("budget_warnings", lambda l, o: aggregate.budget_warnings(flow.eligible_of(l, o), o), TOKENS)


over_flow("skip_counts", lambda f, rules: flow.skip_report(f, SMALL_FILES, rules))
over_flow("repo_stats", lambda f, rules: aggregate.repo_stats(flow.skip_report(f, SMALL_FILES, rules)))

over_flow("skip_counts_capped", lambda f, rules: flow.skip_report(f, CAPPED, rules))
over_flow("repo_stats_capped", lambda f, rules: aggregate.repo_stats(flow.skip_report(f, CAPPED, rules)))
over_flow("budget_warnings_kept", lambda f, rules: flow.warnings(f, SMALL_TOKENS, rules))

# ------------------------------------------------- ranks, limits, set operations ----
over_facts("rank_by_score", lambda f: rank.rank_within_repo(
    score.scored(f, AUTO).select(*KEY, "score"), rank.score_order(), costly=True))
over_facts("critical_files", lambda f: rank.critical_files(score.scored(f, AUTO).select(*KEY, "score")))
over_files("metadata_order", lambda f: rank.rank_within_repo(f.select(*KEY, "size"), rank.metadata_order()))
over_files("cap_files", lambda f: rank.cap_files(f.select(*KEY, "size"), FILE_CAP))
over_files("priority_cap", lambda f: rank.priority_cap(f.select(*KEY), PRIORITY_CAP))
over_files("priority_union_rest", lambda f: rank.priority_union_rest(f.select(*KEY)))
over_files("largest_files", lambda f: rank.largest_files(f.select(*KEY, "size")))
over_facts("effective_extensions", lambda f: detect.effective_extensions(
    detect.detect_repo_type(f), USER_LISTS), USER_LISTS)

# -------------------------------------------------------------------- scoring ----
SCORE_QUERIES = {
    "score_docs": ["docs_points"], "score_config": ["config_points"],
    "score_entry": ["entry_points"], "score_folder": ["folder_points"],
    "score_extension": ["extension_points"], "score_size": ["size_points"],
    "score_imports": ["import_points"], "score_definitions": ["definition_points"],
    "score_architecture": ["architecture_points"], "score_recency": ["recency_points"],
    "score_infra": ["infra_points"],
    "score_penalties": ["generated_points", "minified_points", "test_points"],
}
for _name, _terms in SCORE_QUERIES.items():
    over_facts(_name, lambda f, t=tuple(_terms): f.select(
        *KEY, *[score.terms(INFRA)[c].alias(c) for c in t]))
over_facts("score_files", lambda f: score.score_files(f, INFRA).select(*KEY, *score.terms(INFRA), "score"))

# -------------------------------------------------------------------- budgets ----
over_flow("size_budget", lambda f, rules: budget.size_budget(flow.eligible(f, AUTO, rules), AUTO).select(
    *KEY, "size", "chars", "is_main", "used_before"))


def _walked(table: DataFrame) -> DataFrame:
    return budget.token_budget(score.scored(table, TOKENS).select(*KEY, "score", "size"), TOKENS)


over_facts("token_budget", lambda f: _walked(f))
over_facts("summarized_picks", lambda f: _walked(f).where("summarized").select(*KEY))

# -------------------------------------------------------------- text functions ----
over_files("strip_comments_c", lambda f: f.where(
    paths.lower_ext().isin(fixed.C_COMMENT_EXTENSIONS)).select(*KEY, comments.strip_c().alias("text")))
over_files("strip_comments_py", lambda f: f.where(paths.lower_ext().isin(".py", ".rb")).select(
    *KEY, F.when(paths.lower_ext() == ".py", comments.strip_python()).otherwise(
        comments.strip_hash()).alias("text")))
over_files("collapse_blank_lines", lambda f: f.select(*KEY, comments.collapse_blank_lines().alias("text")))
over_files("strip_comments", lambda f: f.select(
    *KEY, comments.strip_comments("content", paths.lower_ext()).alias("text")))


@query
def strip_comments_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.spread(sample.read(spark, sf_dir, "pages"), "page_id")
    return pages.select("page_id", comments.strip_markup("html").alias("text"))




def repeated(files: DataFrame) -> DataFrame:
    """The files with their content six times over, long enough to be summarised."""
    return files.withColumn("content", F.repeat(F.concat("content", F.lit("\n")), F.lit(6)))


over_files("summarize_code", lambda f: f.select(
    *KEY, summary.summarize_code("content", paths.lower_ext()).alias("summary")))
over_files("summarize_long_code", lambda f: repeated(f).select(
    *KEY, summary.summarize_code("content", paths.lower_ext()).alias("summary")))
over_files("summary_header", lambda f: repeated(f).select(
    *KEY, summary.header_end(F.split("content", "\n", -1), paths.lower_ext()).cast("bigint").alias("header_lines")))
over_files("extract_definitions", lambda f: repeated(f).select(
    *KEY, F.explode(summary.file_definitions("content", paths.lower_ext())).alias("d")).select(
    *KEY, (F.col("d.at") + 1).cast("bigint").alias("line"), F.col("d.name").alias("name")))
over_files("render_content", lambda f: f.select(*KEY, render.rendered(SMALL_FILES).alias("body")))
over_files("redact_credentials", lambda f: redact.redact(f).select(*KEY, "content", "found"))
over_files("credential_findings", lambda f: redact.findings_table(redact.redact(f)))
over_files("credential_type", lambda f: redact.pattern_matches(f).select(*KEY, "pattern", "n", "match", "type"))
over_files("credential_false_positive", lambda f: redact.pattern_matches(f).select(
    *KEY, "pattern", "n", "value", "is_false_positive"))
over_files("redact_env", lambda f: redact.redact_env(f).select(
    *KEY, "content", F.size("findings").cast("bigint").alias("findings")))
# The same texts with the line ends of old systems, which end a line of an environment file as well.
over_files("redact_env_cr", lambda f: redact.findings_table(redact.redact_env(
    f.withColumn("content", F.replace("content", F.lit("\n"), F.lit("\r"))))))
over_files("security_report", lambda f: aggregate.report_lines(
    written(redact.findings_table(redact.redact(f)), "findings")))
for _pattern in R.PATTERNS:
    over_files(f"redact_{_pattern.name}", lambda f, p=_pattern: redact.redact_pattern(f, p).select(
        *KEY, "content", F.size("findings").cast("bigint").alias("findings")))

# ------------------------------------------------------------------- documents ----
over_flow("pack_document", lambda f, rules: flow.pack(f, AUTO, rules))
over_flow("strict_report", lambda f, rules: flow.pack_reported(f, STRICT, rules).report)
over_flow("pack_document_small_tokens", lambda f, rules: flow.pack(f, SMALL_TOKENS, rules))
over_flow("listing_document", lambda f, rules: flow.listing_documents(f, AUTO, rules))
over_flow("pack_parts", lambda f, rules: flow.pack_parts(f, TREE, rules))
over_flow("list_files_capped", lambda f, rules: flow.kept(f, CAPPED, rules).select(*KEY, "size", "rank"))
over_flow("list_files", lambda f, rules: flow.list_files(f, AUTO, rules))
over_flow("dry_run_summary", lambda f, rules: flow.dry_run(f, AUTO, rules))
over_files("file_block", lambda f: f.select(*KEY, render.file_block(AUTO).alias("block")))
