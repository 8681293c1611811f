"""The whole job: select, budget, rank, clean, pack.

    files -> facts -> select -> size budget
                                     |
    files -- join on (repository, path) -> texts -> score -> token budget -> redact -> render -> pack

``from_listing`` takes files that are listed and not yet read: names and sizes
decide first, and only files that a look or the budget needs are opened.

For a table of files, the first pass over all content takes only its length and, where names do not
decide, a look at its opening.  Everything up to the join works on narrow rows.
The second pass filters the texts of the files in budget out of the scan; what
is costly per character runs on those alone.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoweave.functions import paths
from repoweave.operators import aggregate, detect, gitignore, rank, redact, render, score, select
from repoweave.operators.budget import size_budget, token_budget, within_reach
from repoweave.operators.facts import facts, named_facts
from repoweave.plans.options import PackOptions
from repoweave.sources.scratch import broadcast_if_small, fits_broadcast, written

KEY = ["repo_id", "path"]
NARROW = [*KEY, "size", "mtime", "chars"]


class Listed(NamedTuple):
    """Files of a listing after the selection; the functions below take it in place of a table of files."""

    labels: DataFrame  # all files: repo_id, path, size, mtime, selected
    rows: DataFrame  # those the size budget could keep: repo_id, path, size, mtime, chars
    texts: DataFrame  # the same files with content


Files = DataFrame | Listed


class Packed(NamedTuple):
    """Documents and, where the options show what was redacted, the lines of the credential report."""

    documents: DataFrame
    report: DataFrame | None


def first_labels(files: DataFrame, opts: PackOptions) -> DataFrame:
    """The facts of every file with the decision that its own row allows."""
    table = facts(files, opts)
    if opts.needs_detection:
        context = detect.repo_context(detect.detect_repo_type(facts(files, opts)), opts)
        table = table.join(context, "repo_id", "left")
    return table.withColumn("first_reason", select.first_reason(opts))


def _with_rules(table: DataFrame, files: DataFrame, opts: PackOptions, rules: DataFrame | None) -> DataFrame:
    if opts.respect_gitignore:
        table = gitignore.with_ignored(table, gitignore.rule_sets(files) if rules is None else rules)
    return table.withColumn("reason", select.reason(opts)).drop("first_reason", "is_gitignored")


def labelled(files: DataFrame, opts: PackOptions, rules: DataFrame | None = None) -> DataFrame:
    """The facts of every file with ``reason`` and ``selected``.

    ``rules`` are the rule sets of the repositories; by default those of their
    own ignore files.
    """
    table = _with_rules(first_labels(files, opts), files, opts, rules)
    return table.withColumn("selected", select.is_accepted())


def _fits(table: DataFrame, opts: PackOptions) -> DataFrame:
    return table.where(~paths.is_binary() & select.fits_file_limit(opts))


def eligible_of(labels: DataFrame, opts: PackOptions) -> DataFrame:
    return _fits(labels.where("selected"), opts)


def accepted(files: DataFrame, opts: PackOptions, rules: DataFrame | None = None) -> DataFrame:
    """The facts of the accepted files.

    What a row decides by itself is filtered before the rules are joined, so
    rejected files are not shuffled.
    """
    candidates = first_labels(files, opts).where(select.is_accepted("first_reason"))
    return _with_rules(candidates, files, opts, rules).where(select.is_accepted())


def from_listing(
    listing: DataFrame, read: Callable[[DataFrame], DataFrame], opts: PackOptions = PackOptions.preset(),
    rules: DataFrame | None = None,
) -> Listed:
    """Selects listed files and reads the few whose content matters.

    ``read`` gives a table of files for the rows of a listing that it is handed; it may leave out
    files that it cannot read.  It sees the root ignore files, the small files that no name decides,
    and the files that the size budget could keep by their sizes.  The options must be those of the
    calls that follow.
    """
    names = listing.select(*KEY, "size", "mtime")
    table = named_facts(names, opts)
    if opts.needs_detection:
        context = detect.repo_context(detect.detect_repo_type(table), opts)
        table = table.join(context, "repo_id", "left")
    table = table.withColumn("first_reason", select.first_reason(opts))
    if opts.respect_gitignore and rules is None:
        rules = gitignore.rule_sets(read(listing.where(F.col("path") == ".gitignore")))
    labels = written(
        _with_rules(table, names, opts, rules).select(*KEY, "size", "mtime", "reason"), "labels"
    )
    looked_at = _listed(listing, labels.where(F.col("reason") == "content"))
    code = facts(read(looked_at), opts).where("looks_like_code").select(*KEY, F.lit(True).alias("_code"))
    chosen = select.is_accepted() & ((F.col("reason") != "content") | F.coalesce("_code", F.lit(False)))
    labels = written(
        labels.join(code, KEY, "left").select(*KEY, "size", "mtime", chosen.alias("selected")), "looked_at"
    )
    near = within_reach(capped(labels.where("selected").drop("selected"), opts), opts)
    texts = written(read(_listed(listing, near)).select(*KEY, "size", "mtime", "content"), "texts")
    rows = texts.select(*KEY, "size", "mtime", F.length("content").cast("bigint").alias("chars"))
    return Listed(labels, rows, texts)


def _listed(listing: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a listing that ``rows`` names."""
    return listing.join(rows.select(*KEY), KEY, "left_semi")


def eligible(files: Files, opts: PackOptions, rules: DataFrame | None = None) -> DataFrame:
    """Accepted files under the file cap that are not binary and fit the file limit.

    The narrow rows are written, so content is read once.  The cap touches only
    repositories with more files than it, at most all rows / cap of them; only
    their rows are ranked.
    """
    if isinstance(files, Listed):
        return files.rows
    narrow = accepted(files, opts, rules).select(*NARROW)
    return capped(written(narrow, "accepted"), opts)


def capped(rows: DataFrame, opts: PackOptions) -> DataFrame:
    """Written rows of accepted files that stay under the file cap and fit the file limit."""
    cap = opts.max_files
    sizes = rows.groupBy("repo_id").agg(F.count("*").alias("n"))
    over = sizes.where(F.col("n") > cap).select("repo_id")
    if over.isEmpty():
        return _fits(rows, opts)
    over = broadcast_if_small(written(over, "over_cap"))
    found = rank.priority_cap(rows.join(over, "repo_id", "left_semi"), cap).drop("rank", "is_priority")
    chosen = rank.cap_files(_fits(found, opts), cap).drop("rank")
    return _fits(rows.join(over, "repo_id", "left_anti"), opts).unionByName(chosen)


def budgeted(files: Files, opts: PackOptions, rules: DataFrame | None = None) -> DataFrame:
    """The files that fit the size budget; it bounds every repository from here on."""
    return size_budget(eligible(files, opts, rules), opts).select(*NARROW)


def ranked(rows: DataFrame, opts: PackOptions) -> DataFrame:
    """``rows`` of the budget in document order, the token budget applied if files are scored.

    Scores look at ``content``; the result does not carry it.
    """
    if opts.smart:
        scored = score.scored(facts(rows, opts), opts).select(*KEY, "size", "chars", "score")
        return token_budget(scored, opts, bounded=True).drop("score", "cost")
    order = Window.partitionBy("repo_id").orderBy(*rank.metadata_order())
    return rows.select(
        *KEY, "size", "chars", F.lit(False).alias("summarized"),
        F.row_number().over(order).cast("bigint").alias("rank"),
    )


def kept(files: Files, opts: PackOptions, rules: DataFrame | None = None) -> DataFrame:
    """The files that go into the documents: path, size, chars, rank, whether summarised."""
    rows = budgeted(files, opts, rules)
    return ranked(with_content(rows, files) if opts.smart else rows, opts)


def with_content(rows: DataFrame, files: Files) -> DataFrame:
    """Late materialisation: ``rows`` (with ``size``) joined to their text.

    The rows are written once and measured.  A small table is broadcast and the
    texts are filtered in their scan.  A large one is joined by shuffle, after a
    broadcast of the largest kept size per repository, two numbers each, has
    dropped most texts before they move; if even that is too large, the shuffle
    does without.
    """
    files = files.texts if isinstance(files, Listed) else files
    keys = written(rows, "kept")
    texts = files.select(*KEY, "content")
    if fits_broadcast(keys):
        return texts.join(F.broadcast(keys), KEY)
    largest = written(
        keys.groupBy(F.xxhash64("repo_id").alias("_repo")).agg(F.max("size").alias("_largest")), "largest"
    )
    if fits_broadcast(largest):
        texts = files.select(*KEY, "size", "content").join(
            F.broadcast(largest),
            (F.xxhash64("repo_id") == F.col("_repo")) & (F.col("size") <= F.col("_largest")),
        ).select(*KEY, "content")
    return texts.join(keys, KEY)


def kept_texts(files: Files, opts: PackOptions, rules: DataFrame | None = None) -> DataFrame:
    """The kept files with their content."""
    rows = budgeted(files, opts, rules)
    if not opts.smart:
        return with_content(ranked(rows, opts), files)
    # Needed for the score and for the document, and bounded by the size budget.
    texts = written(with_content(rows, files), "texts")
    return ranked(texts, opts).join(texts.select(*KEY, "content"), KEY)


def pack_bodies(files: Files, opts: PackOptions, rules: DataFrame | None = None) -> DataFrame:
    """The kept files with their cleaned ``body``; the long form of the documents."""
    return _rendered(_redacted(files, opts, rules), opts)


def _redacted(files: Files, opts: PackOptions, rules: DataFrame | None) -> DataFrame:
    rows = kept_texts(files, opts, rules)
    return redact.redact(rows, opts.patterns) if opts.redact_credentials else rows


def _rendered(rows: DataFrame, opts: PackOptions) -> DataFrame:
    return rows.withColumn("body", render.rendered(opts, "summarized"))


def pack(files: Files, opts: PackOptions = PackOptions.preset(), rules: DataFrame | None = None) -> DataFrame:
    """One Markdown document per repository."""
    return render.documents(pack_bodies(files, opts, rules), opts)


def pack_reported(
    files: Files, opts: PackOptions = PackOptions.preset(security="strict"), rules: DataFrame | None = None
) -> Packed:
    """Documents with the credential report of a strict run, from one redaction of the kept files.

    The redacted texts are written once, within the size budget; documents and report read them.
    """
    if not (opts.redact_credentials and opts.show_redacted):
        return Packed(pack(files, opts, rules), None)
    rows = written(_redacted(files, opts, rules), "redacted")
    return Packed(render.documents(_rendered(rows, opts), opts), aggregate.report_lines(redact.findings_table(rows)))


def pack_parts(files: Files, opts: PackOptions = PackOptions.preset(), rules: DataFrame | None = None) -> DataFrame:
    """The documents as text rows ``repo_id, part, key, pos, text``, with the tree if asked for.

    A tree is not bounded by any budget, so these documents are never put
    together in one place: written in order they are the document.
    """
    bodies = written(pack_bodies(files, opts, rules).select(*KEY, "size", "rank", "body"), "bodies")
    parts = render.document_parts(bodies, opts)
    if opts.tree:
        repos = bodies.select("repo_id").distinct()
        tree = aggregate.directory_tree(files.labels if isinstance(files, Listed) else files).join(repos, "repo_id", "left_semi")
        parts = parts.unionByName(render.tree_parts(tree, bodies))
    return parts


def list_files(files: Files, opts: PackOptions = PackOptions.preset(), rules: DataFrame | None = None) -> DataFrame:
    """The files a document would hold, by directory.

    The budget counts characters, so content is looked at, for a ``Listed`` only that within reach.
    """
    return kept(files, opts, rules).select(
        "repo_id", paths.dirname().alias("dir"), "rank", paths.basename().alias("name"), "size",
        F.concat(F.lit("- "), paths.basename(), F.lit(" ("), paths.human_size(), F.lit(")")).alias("entry"),
    )


def listing_documents(
    files: Files, opts: PackOptions = PackOptions.preset(), rules: DataFrame | None = None
) -> DataFrame:
    """One document per repository that lists the kept files without their contents."""
    return render.listings(kept(files, opts, rules), opts)


def warnings(files: Files, opts: PackOptions = PackOptions.preset(), rules: DataFrame | None = None) -> DataFrame:
    """Whether what the size budget left of a repository still exceeds its limits."""
    return aggregate.budget_warnings(budgeted(files, opts, rules), opts)


def dry_run(files: Files, opts: PackOptions = PackOptions.preset(), rules: DataFrame | None = None) -> DataFrame:
    return aggregate.dry_run_summary(kept(files, opts, rules))


def skip_report(files: Files, opts: PackOptions = PackOptions.preset(), rules: DataFrame | None = None) -> DataFrame:
    """What each stage dropped, per repository.

    The narrow labels are written, as several plans need them and content should be read once.  The
    file cap drops the same files as in a document.
    """
    if isinstance(files, Listed):
        under_cap = capped(files.labels.where("selected").drop("selected"), opts)
        return aggregate.skip_counts(files.labels, size_budget(files.rows, opts), opts, under_cap)
    labels = written(labelled(files, opts, rules).select(*NARROW, "selected"), "labels")
    under_cap = capped(labels.where("selected").drop("selected"), opts)
    return aggregate.skip_counts(labels, size_budget(under_cap, opts), opts, under_cap)


def security_report(files: Files, opts: PackOptions = PackOptions.preset(security="strict"), rules: DataFrame | None = None) -> DataFrame:
    """The findings in the files that would be packed."""
    rows = redact.redact(kept_texts(files, opts, rules), opts.patterns)
    return aggregate.findings_report(redact.findings_table(rows))


def report_lines(files: Files, opts: PackOptions = PackOptions.preset(security="strict"), rules: DataFrame | None = None) -> DataFrame:
    """The security report with its title, file headings and totals."""
    findings = redact.findings_table(redact.redact(kept_texts(files, opts, rules), opts.patterns))
    return aggregate.report_lines(written(findings, "findings"))
