"""Facts about commits and pull requests in commands and their output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shells that run what follows -c; characters of a branch's name, of a hash and of a host.
SHELLS = ("sh", "bash", "zsh", "dash", "ksh")
_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_BRANCH, _HEX, _HOST = _LOWER + _DIGITS + "_./+-", _DIGITS + "abcdef", _LOWER + _DIGITS + "_.-"
#: Stands between words where a command is looked for as a run of words.
_BETWEEN = "\x01"


def _only(text: Column, allowed: str) -> Column:
    return (F.translate(text, allowed, "") == "") & (text != "")


def commit_facts(output: Column) -> Column:
    """Struct (branch, sha, subject, files_changed, insertions, deletions) of a commit's output; null
    without a commit line.

    A commit is announced in brackets: its branch, a note if it is the first one, its hash; the subject
    follows.  The line that counts changes lists them between commas.
    """
    def announced(piece: Column) -> Column:
        inside = F.split(F.trim(F.substring_index(piece, "]", 1)), r"\s+")
        return F.struct(
            F.element_at(inside, 1).alias("branch"), F.element_at(inside, -1).alias("sha"),
            ((F.size(inside) == 2) | ((F.size(inside) == 3) & (F.try_element_at(inside, F.lit(2)) == "(root-commit)"))).alias("shaped"),
            F.trim(F.substring_index(F.substring(piece, F.instr(piece, "]") + 1, 1 << 20), "\n", 1)).alias("subject"),
        )

    brackets = F.filter(F.split(output, r"\["), lambda x, i: (i > 0) & F.contains(x, F.lit("]")))
    commits = F.filter(F.transform(brackets, announced), lambda c: (
        c["shaped"] & _only(F.lower(c["branch"]), _BRANCH) & _only(c["sha"], _HEX) & F.length(c["sha"]).between(7, 40)
    ))
    commit = F.try_element_at(commits, F.lit(1))
    counted = F.filter(F.split(output, "\n"), lambda x: F.contains(x, F.lit(" file changed")) | F.contains(x, F.lit(" files changed")))
    counts = F.transform(F.split(F.try_element_at(counted, F.lit(1)), ","), lambda x: F.trim(x))

    def number(kind: str) -> Column:
        own = F.filter(counts, lambda x: F.split(x, " ")[1].startswith(kind))
        return F.substring_index(F.try_element_at(own, F.lit(1)), " ", 1).try_cast("int")

    return F.when(commit.isNotNull(), F.struct(
        commit["branch"].alias("branch"), commit["sha"].alias("sha"), F.nullif(commit["subject"], F.lit("")).alias("subject"),
        number("file").alias("files_changed"), number("insertion").alias("insertions"), number("deletion").alias("deletions"),
    ))


def pull_requests(output: Column) -> Column:
    """Distinct (host, owner, repo, number) of the pull and merge requests whose URLs an output holds.

    The output is cut where a scheme ends; what follows http or https is an address up to a blank or a
    quote mark, and its path tells the forge.
    """
    pieces = F.split(F.coalesce(output, F.lit("")), "://")
    both = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("b"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("v"))
    web = F.filter(both, lambda x: x["b"].endswith("http") | x["b"].endswith("https"))
    paths = F.transform(web, lambda x: F.split(F.element_at(F.split(x["v"], r'[\s"]', 2), 1), "/"))

    def request(p: Column) -> Column:
        at = lambda k: F.try_element_at(p, F.lit(k))
        number = F.when(at(4) == "pull", at(5)).when((at(4) == "-") & (at(5) == "merge_requests"), at(6))
        return F.struct(
            at(1).alias("host"), at(2).alias("owner"), at(3).alias("repo"),
            F.regexp_extract(number, "^[0-9]+", 0).try_cast("long").alias("number"),
        )

    found = F.filter(F.transform(paths, request), lambda r: (
        r["number"].isNotNull() & _only(F.lower(r["host"]), _HOST) & (r["owner"] != "") & (r["repo"] != "")
    ))
    return F.array_distinct(found)


def words(command: Column) -> Column:
    """Words of a command line: quotes keep blanks together and go, a backslash takes the next character
    as it is; what separates commands is a word of its own."""
    piece = r"""(?s)[;&|]+|(?:\\.|"(?:\\.|[^"\\])*"|'[^']*'|[^\s"'\\;&|])+"""
    found = F.regexp_extract_all(command, F.lit(piece), F.lit(0))
    inner = r"""(?s)\\(.)|"((?:\\.|[^"\\])*)"|'([^']*)'"""
    return F.transform(found, lambda w: F.regexp_replace(F.regexp_replace(w, inner, "$1$2$3"), r"(?s)\\(.)", "$1"))


def script(command: Column) -> Column:
    """What runs: a shell whose options hold a c runs its first word that is no option; else the command."""
    args = words(command)
    is_shell = F.element_at(F.split(F.try_element_at(args, F.lit(1)), "/"), -1).isin(*SHELLS)
    given = F.slice(args, F.lit(2), F.greatest(F.size(args) - 1, F.lit(0)))
    plain = F.array_position(F.transform(given, lambda w: w.startswith("-")), F.lit(False)).cast("int")
    options = F.slice(given, F.lit(1), F.greatest(plain - 1, F.lit(0)))
    takes = F.exists(options, lambda w: ~w.startswith("--") & F.contains(w, F.lit("c")))
    inner = F.when(is_shell & (plain > 0) & takes, F.try_element_at(given, plain))
    return F.coalesce(inner, command)


def _runs(args: Column, *names: str) -> Column:
    """Whether the words hold ``names`` one after another."""
    line = F.concat(F.lit(_BETWEEN), F.array_join(args, _BETWEEN), F.lit(_BETWEEN))
    return F.contains(line, F.lit(_BETWEEN + _BETWEEN.join(names) + _BETWEEN))


def is_commit(command: Column) -> Column:
    """Whether a command commits, whatever options git is given before; quoted text does not count."""
    plain = F.filter(words(script(command)), lambda w: ~w.startswith("-"))
    return F.coalesce(_runs(plain, "git", "commit"), F.lit(False))


def creates_pull_request(command: Column) -> Column:
    args = words(script(command))
    return F.coalesce(_runs(args, "gh", "pr", "create") | _runs(args, "glab", "mr", "create"), F.lit(False))


def pull_request_flags(command: Column) -> Column:
    """Struct (title, base_branch, head_branch) as given by --title, --base and --head, inline or as the
    next argument; a flag that is followed by another flag has no value."""
    args = words(script(command))

    def value(flag: str) -> Column:
        at = F.transform(args, lambda w, i: F.when(
            w.startswith(f"{flag}="), F.substring(w, len(flag) + 2, 1 << 20)
        ).when(w == flag, F.try_element_at(args, i + 2)))
        given = F.filter(at, lambda v: v.isNotNull() & (v != "") & ~v.startswith("--"))
        return F.try_element_at(given, F.lit(-1))

    return F.struct(value("--title").alias("title"), value("--base").alias("base_branch"), value("--head").alias("head_branch"))


def remote(url: Column) -> Column:
    """Struct (host, owner, repo) of a remote's ssh or https URL without .git; null if it is neither."""
    clean = F.trim(url)
    clean = F.when(clean.endswith(".git"), F.left(clean, F.length(clean) - 4)).otherwise(clean)
    by_ssh = clean.startswith("git@") & F.contains(clean, F.lit(":"))
    by_web = F.substring_index(clean, "://", 1).isin("http", "https") & F.contains(clean, F.lit("://"))
    address = F.when(by_ssh, F.substring(clean, 5, 1 << 20)).when(by_web, F.substring(clean, F.instr(clean, "://") + 3, 1 << 20))
    cut = F.when(by_ssh, F.instr(address, ":")).otherwise(F.instr(address, "/"))
    host, path = F.left(address, cut - 1), F.substring(address, cut + 1, 1 << 20)
    owner = F.substring_index(path, "/", 1)
    repo = F.substring(path, F.length(owner) + 2, 1 << 20)
    whole = (cut > 1) & F.contains(path, F.lit("/")) & (owner != "") & (repo != "")
    return F.when(whole, F.struct(host.alias("host"), owner.alias("owner"), repo.alias("repo")))


def pull_request_state(state: Column, merged_at: Column, closed_at: Column) -> Column:
    """Struct (state, closed_at) in lower case; a merged one closed when it was merged."""
    return F.struct(F.lower(state).alias("state"), F.coalesce(merged_at, closed_at).alias("closed_at"))
