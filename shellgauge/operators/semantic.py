"""Semantic risk class of a simple command, from its head and its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.catalogs.lexicon import CLASS_BASE, HEADS_BY_CLASS
from shellgauge.functions.text import any_of, basename, let, literal, split_words, starts_with_any

# Words and patterns of the special cases.
GIT_READ_ONLY = """
    status log diff show blame branch remote stash ls-files describe shortlog reflog config
""".split()
RM_CRITICAL = "/ /* ~ ~/* /home /etc /usr /var /boot /bin /sbin".split()
CHMOD_SENSITIVE = "/ ~/ /etc /usr /bin /sbin".split()
DD_BLOCK = r"of=/dev/(sd|hd|nvme|vd|md|mmcblk|loop)"
DD_NULL = r"of=/dev/(zero|null)"
DOCKER_READ = "ps images logs inspect".split()
KILL_INIT = r"\bkill\s+-9?\s+(-?1|\$\$)\b"
KILLALL_CRITICAL = r"\bkillall\s+(sshd|init|systemd|dbus)\b"
PKILL_ROOT = r"\bpkill\s+-9\s+-u\s+root\b"
SECRET_MARKS = """
    /etc/shadow /etc/gshadow /etc/sudoers ~/.ssh/id_ ~/.ssh/authorized_keys ~/.aws/credentials
    ~/.docker/config.json ~/.kube/config ~/.gnupg/ ~/.netrc /root/.ssh .bash_history .zsh_history
    .mysql_history
""".split()
REMOTE_HOST = r"\b[\w.-]+@[\w.-]+:"


def lexicon_map() -> Column:
    """Head to class, as a literal map."""
    return literal({h: cls for cls, hs in HEADS_BY_CLASS.items() for h in hs.split()}, "map<string,string>")


def head_class(head: Column) -> Column:
    """Class of a head; UNKNOWN when the lexicon does not list it."""
    return F.coalesce(F.try_element_at(lexicon_map(), head), F.lit("UNKNOWN"))


def head_class_lookup(atoms: DataFrame, lexicon: DataFrame, head: str = "head") -> DataFrame:
    """The same lookup as an outer equi-join to the lexicon table."""
    from shellgauge.session import small

    found = atoms.join(small(lexicon.select(F.col("head").alias(head), "class")), head, "left")
    return found.withColumn("class", F.coalesce("class", F.lit("UNKNOWN")))


def _case(cls: str, score: float | Column, reason: str | Column) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(cls).alias("class"), as_col(score).cast("double").alias("score"),
        as_col(reason).alias("reason"),
    )


def _base(cls: Column, base: dict[str, float]) -> Column:
    return F.element_at(literal(base, "map<string,double>"), cls)


def _git(words: Column, base: dict[str, float]) -> Column:
    sub = F.element_at(words, 2)
    has = lambda *w: F.arrays_overlap(words, F.array(*[F.lit(x) for x in w]))
    listing = (sub == "tag") & ((F.size(words) == 2) | has("-l", "--list"))
    cls = F.when(sub.isin(GIT_READ_ONLY) | listing, F.lit("READ_ONLY")).otherwise(F.lit("WRITE_LOCAL"))
    forced = F.exists(words, lambda w: w.startswith("-f") | w.startswith("-d"))
    return (
        F.when((sub == "push") & has("-f", "--force", "--force-with-lease"),
               _case("DESTRUCTIVE", 0.85, "git_push_force"))
        .when((sub == "reset") & has("--hard"), _case("DESTRUCTIVE", 0.80, "git_reset_hard"))
        .when((sub == "clean") & forced, _case("DESTRUCTIVE", 0.70, "git_clean_force"))
        .otherwise(F.struct(cls.alias("class"), _base(cls, base).alias("score"),
                            F.concat(F.lit("git_"), sub).alias("reason")))
    )


def _rm(words: Column) -> Column:
    rest = F.slice(words, F.lit(2), F.size(words))
    options = F.array_join(F.filter(rest, lambda w: w.startswith("-")), " ")
    critical = F.try_element_at(F.filter(rest, lambda w: w.isin(RM_CRITICAL)), F.lit(1))
    recursive = any_of(options, ["-r", "-R", "--recursive"])
    force = any_of(options, ["-f", "--force"])
    return (
        F.when((recursive & force) | any_of(options, ["-rf", "-fr"]),
               F.when(critical.isNotNull(),
                      _case("DESTRUCTIVE", 1.0, F.concat(F.lit("rm_rf_critical:"), critical)))
               .otherwise(_case("DESTRUCTIVE", 0.9, "rm_rf")))
        .when(recursive, _case("DESTRUCTIVE", 0.7, "rm_recursive"))
        .otherwise(_case("WRITE_LOCAL", 0.3, "rm_files"))
    )


def _chmod(words: Column) -> Column:
    rest = F.slice(words, F.lit(2), F.size(words))
    mode = F.coalesce(F.try_element_at(F.filter(rest, lambda w: ~w.startswith("-")), F.lit(1)), F.lit(""))
    octal = mode.rlike(r"^[0-7]{3,4}$")
    full = octal & (F.substring(mode, -3, 3) == "777")
    sensitive = F.exists(
        F.slice(words, F.lit(3), F.size(words)),
        lambda w: ~w.startswith("-") & starts_with_any(w, CHMOD_SENSITIVE),
    )
    p = "PRIVILEGE_OR_PERMISSION"
    return (
        F.when(full & sensitive, _case(p, 0.95, "chmod_777_sensitive"))
        .when(full, _case(p, 0.80, "chmod_777"))
        .when(octal & mode.rlike("^[42]"), _case(p, 0.85, F.concat(F.lit("chmod_suid:"), mode)))
        .when(mode.contains("+s"), _case(p, 0.85, "chmod_setuid_sym"))
        .otherwise(_case(p, 0.35, "chmod_normal"))
    )


def classify(atom: Column, class_base: dict[str, float] | None = None) -> Column:
    """Class, score and reason of one simple command."""
    base = {**CLASS_BASE, **(class_base or {})}

    def decide(w: Column) -> Column:
        words, joined, args, prog, cls = w["words"], w["joined"], w["args"], w["prog"], w["cls"]
        has = lambda x: F.array_contains(words, x)
        local = F.lit(base["WRITE_LOCAL"])
        return (
            F.when(F.size(words) == 0, _case("READ_ONLY", 0.0, "empty"))
            .when((prog == "git") & (F.size(words) > 1), _git(words, base))
            .when(prog == "rm", _rm(words))
            .when(prog == "chmod", _chmod(words))
            .when(prog == "dd",
                  F.when(joined.rlike(DD_BLOCK), _case("DESTRUCTIVE", 1.0, "dd_block_device"))
                  .when(joined.rlike(DD_NULL), _case("READ_ONLY", 0.1, "dd_to_null"))
                  .otherwise(_case("DESTRUCTIVE", 0.6, "dd_generic")))
            .when((prog == "sed") & F.exists(words, lambda x: x.startswith("-i")),
                  _case("WRITE_LOCAL", local, "sed_inplace"))
            .when(prog.isin("docker", "podman"),
                  F.when(has("run") & has("--privileged"),
                         _case("PRIVILEGE_OR_PERMISSION", 0.90, "docker_privileged"))
                  .when(F.exists(words, lambda x: x.isin(DOCKER_READ)),
                        _case("READ_ONLY", 0.0, "docker_read"))
                  .otherwise(_case("WRITE_LOCAL", local, "docker_other")))
            .when(prog.isin("kill", "pkill", "killall"),
                  F.when(joined.rlike("(?U)" + KILL_INIT), _case("RESOURCE_ABUSE", 0.95, "kill_init"))
                  .when(joined.rlike("(?U)" + KILLALL_CRITICAL),
                        _case("RESOURCE_ABUSE", 0.90, "killall_critical"))
                  .when(joined.rlike("(?U)" + PKILL_ROOT), _case("RESOURCE_ABUSE", 0.90, "pkill_root"))
                  .otherwise(_case("RESOURCE_ABUSE", base["RESOURCE_ABUSE"], "kill_generic")))
            .when(any_of(args, SECRET_MARKS) & cls.isin("WRITE_LOCAL", "READ_ONLY"),
                  _case("WRITE_SENSITIVE", base["WRITE_SENSITIVE"],
                        F.concat(prog, F.lit(":secret_path"))))
            .when(prog.isin("rsync", "scp", "sftp") & ~args.rlike("(?U)" + REMOTE_HOST),
                  _case("WRITE_LOCAL", local, F.concat(prog, F.lit(":local_no_remote_host"))))
            .otherwise(F.struct(cls.alias("class"), _base(cls, base).alias("score"),
                                F.concat(F.lit("db_lookup:"), prog).alias("reason")))
        )

    def facts(words: Column) -> Column:
        prog = basename(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")))
        return let(prog, lambda p: let(
            F.struct(
                words.alias("words"), F.array_join(words, " ").alias("joined"),
                F.array_join(F.slice(words, F.lit(2), F.size(words)), " ").alias("args"),
                p.alias("prog"), head_class(p).alias("cls"),
            ), decide))

    return let(split_words(atom), facts)


def is_git_tag_listing(atom: Column) -> Column:
    """``git tag`` that only lists."""
    return let(split_words(atom), lambda w: (
        (F.size(w) >= 2) & (basename(F.try_element_at(w, F.lit(1))) == "git")
        & (F.try_element_at(w, F.lit(2)) == "tag")
        & ((F.size(w) == 2) | F.arrays_overlap(w, F.array(F.lit("-l"), F.lit("--list"))))
    ))


def semantic_score(classified: Column) -> Column:
    """Highest score, and the class of the first atom that reaches it."""
    def best(top: Column) -> Column:
        first = F.try_element_at(F.filter(classified, lambda a: a["score"] == top), F.lit(1))
        return F.struct(
            F.coalesce(top, F.lit(0.0)).alias("score"),
            F.when(top > 0, first["class"]).otherwise(F.lit("READ_ONLY")).alias("max_class"),
        )

    return let(F.array_max(F.transform(classified, lambda a: a["score"])), best)
