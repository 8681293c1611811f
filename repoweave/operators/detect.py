"""What kind of project a repository is, and what that adds to the selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoweave.functions import fixed, paths
from repoweave.functions.text import is_in
from repoweave.operators.select import extensions_for
from repoweave.plans.options import PackOptions


def detect_repo_type(files: DataFrame) -> DataFrame:
    """One row per repository: five project flags and the root Terraform probe.

    One aggregate over the ``facts`` table, combined on the map side.  Hidden files
    and directories are not looked at.
    """
    path, base, ext = F.col("path"), paths.basename(), paths.extname()
    visible = ~path.rlike(r"(?:^|/)\.")
    flags = {
        "is_terraform": is_in(ext, [".tf", ".tfvars"]),
        "is_kubernetes": is_in(base, fixed.KUBERNETES_NAMES) | base.endswith(".helmignore"),
        "is_ansible": is_in(base, fixed.ANSIBLE_NAMES),
        "is_docker": is_in(base, fixed.DOCKER_NAMES),
        "is_packer": base.endswith(".pkr.hcl") | F.col("has_packer_markers"),
    }
    return files.groupBy("repo_id").agg(
        *[F.bool_or(visible & hit).alias(name) for name, hit in flags.items()],
        F.bool_or(is_in(path, fixed.TERRAFORM_ROOT_NAMES)).alias("has_root_terraform"),
    )


def repo_context(detected: DataFrame, opts: PackOptions = PackOptions()) -> DataFrame:
    """Per repository, the extensions and names that its project type adds to the options."""
    base = extensions_for(opts)

    def when(flag: str, extensions: list[str]):
        if flag != "has_root_terraform" and not opts.auto_detect:
            return F.array().cast("array<string>")
        none = F.array().cast("array<string>")
        return F.when(F.col(flag), F.array(*[F.lit(x) for x in extensions])).otherwise(none)

    yaml_known = any(x in base for x in fixed.KUBERNETES_ADDED_EXTENSIONS)
    added = F.array_distinct(F.concat(
        when("is_terraform", fixed.TERRAFORM_ADDED_EXTENSIONS),
        F.array().cast("array<string>") if yaml_known
        else when("is_kubernetes", fixed.KUBERNETES_ADDED_EXTENSIONS),
        when("is_ansible", fixed.ANSIBLE_ADDED_EXTENSIONS),
        when("has_root_terraform", fixed.TERRAFORM_ROOT_ADDED_EXTENSIONS),
    ))
    return detected.select(
        "repo_id", added.alias("added_extensions"),
        when("is_docker", fixed.DOCKER_ADDED_NAMES).alias("added_names"),
    )


def effective_extensions(detected: DataFrame, opts: PackOptions = PackOptions()) -> DataFrame:
    """Long form ``repo_id, extension``: the options' set united with what detection adds."""
    base = F.array(*[F.lit(x) for x in extensions_for(opts)])
    context = repo_context(detected, opts)
    return context.select(
        "repo_id", F.explode(F.array_union(base, F.col("added_extensions"))).alias("extension")
    )


def with_context(facts: DataFrame, opts: PackOptions) -> DataFrame:
    """``facts`` with ``added_extensions`` and ``added_names``; joins one row per repository."""
    return facts.join(repo_context(detect_repo_type(facts), opts), "repo_id", "left")


def has_any_type(detected: DataFrame) -> DataFrame:
    """``detected`` with ``is_infrastructure``: whether any project type was found."""
    flags = ["is_terraform", "is_kubernetes", "is_ansible", "is_docker", "is_packer"]
    return detected.withColumn("is_infrastructure", F.greatest(*flags))
