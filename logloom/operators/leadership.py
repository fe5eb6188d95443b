"""Leadership as data: epochs of sequence numbers, votes, commit index, leases and write authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.schema import MAX_LONG, SEQUENCES_PER_TERM


def band_start(term: Column) -> Column:
    """term * 10^9, at most the largest long; a negative term fails."""
    top = MAX_LONG // SEQUENCES_PER_TERM
    ok = F.when(term < 0, F.raise_error(F.lit("negative term")).cast("long")).when(term > top, F.lit(MAX_LONG))
    return ok.otherwise(F.least(term, F.lit(top)) * F.lit(SEQUENCES_PER_TERM).cast("long"))


def implied_term(seq: Column) -> Column:
    """The term whose band a sequence number is in; a negative one fails."""
    whole = F.call_function("div", seq, F.lit(SEQUENCES_PER_TERM).cast("long"))
    return F.when(seq < 0, F.raise_error(F.lit("negative sequence number")).cast("long")).otherwise(whole)


def assign_sequence(next_seq: Column, term: Column) -> Column:
    """The number that the first write of a term gets."""
    return F.greatest(next_seq, band_start(term))


def grants_vote(request_term: Column, current_term: Column, voted_for: Column, candidate: Column, candidate_last: Column, my_last: Column) -> Column:
    """candidate_last, my_last: struct(last term, last index)."""
    free = (request_term > current_term) | voted_for.isNull() | (voted_for == candidate)
    return (request_term >= current_term) & free & (candidate_last >= my_last)


def majority(cluster: Column) -> Column:
    return F.floor(cluster / 2) + 1


def election_winners(votes: DataFrame, cluster: int) -> DataFrame:
    """votes(term, voter, candidate) -> (term, candidate, votes) of candidates with a majority of the cluster."""
    n = votes.groupBy("term", "candidate").agg(F.countDistinct("voter").alias("votes"))
    return n.where(F.col("votes") >= cluster // 2 + 1)


def commit_index(entries: DataFrame, match: DataFrame, cluster: int, current_term: int) -> DataFrame:
    """entries(idx, term), match(peer, match_idx) -> the largest index of the term that a majority holds, the leader included; 0 if none.

    The index that k of the peers have reached is the k-th largest match, so
    no entry is compared with a peer.
    """
    need = cluster // 2  # peers besides the leader
    w = Window.orderBy(F.desc("match_idx"), "peer")  # one row for each peer
    reached = match.withColumn("n", F.row_number().over(w)).where(F.col("n") == need).select(F.col("match_idx").alias("reached"))
    if need == 0:
        reached = entries.agg(F.max("idx").alias("reached"))
    ok = entries.where(F.col("term") == current_term).join(F.broadcast(reached), F.col("idx") <= F.col("reached"))
    return ok.agg(F.coalesce(F.max("idx"), F.lit(0)).cast("long").alias("commit_index"))


def lease_valid(acks: DataFrame, cluster: int, terms: DataFrame | None = None) -> DataFrame:
    """acks(term, peer, acked_within) -> (term, acked, lease): the leader and the peers in time are a majority.

    terms(term): also those without peers, where a sole node has its lease at all times.
    """
    if terms is not None:
        none = terms.select("term").distinct().select("term", F.lit(None).cast("int").alias("peer"), F.lit(False).alias("acked_within"))
        acks = acks.select("term", F.col("peer").cast("int").alias("peer"), "acked_within").unionByName(none)
    n = acks.groupBy("term").agg(F.count_if("acked_within").alias("acked"))
    return n.withColumn("lease", (F.col("acked") + 1) * 2 > cluster)


def authoritative(role: Column, commit: Column, no_op: Column, lease: Column) -> Column:
    return (role == "LEADER") & (commit >= no_op) & lease


def write_accepted(op: Column, authority: Column) -> Column:
    """Reads pass; writes need authority."""
    return (op == "GET") | authority


def append_entries(log: DataFrame, request: DataFrame, prev_idx: int, prev_term: int) -> DataFrame:
    """log(idx, term) after a request's entries(idx, term), or unchanged if the entry before them doesn't match.

    Entries from the first conflicting index on are replaced.
    """
    fits = log.where((F.col("idx") == prev_idx) & (F.col("term") == prev_term)) if prev_idx else None
    if fits is not None and fits.isEmpty():
        return log
    theirs = request.select(F.col("idx"), F.col("term").alias("new_term"))
    conflict = log.join(theirs, "idx").where(F.col("term") != F.col("new_term")).agg(F.min("idx")).first()[0]
    kept = log if conflict is None else log.where(F.col("idx") < conflict)
    return kept.unionByName(request.select("idx", "term").join(kept.select("idx"), "idx", "left_anti"))


def handle_append(log: DataFrame, request: DataFrame, *, term: int, current_term: int, prev_idx: int, prev_term: int, leader_commit: int, commit: int) -> tuple[DataFrame, dict]:
    """A follower's answer to entries(idx, term) of a leader: its log afterwards, and term, success, match_idx and commit.

    A request of an older term is refused outright; one whose entry before the
    new ones is missing or of another term is refused with the last index, for the
    leader to step back. The commit index follows the leader's, up to the last
    entry of this request, and never goes back.
    """
    if term < current_term:
        return log, {"term": current_term, "success": False, "match_idx": 0, "commit": commit}
    last = log.agg(F.coalesce(F.max("idx"), F.lit(0))).first()[0]
    if prev_idx and log.where((F.col("idx") == prev_idx) & (F.col("term") == prev_term)).isEmpty():
        return log, {"term": term, "success": False, "match_idx": last, "commit": commit}
    match = request.agg(F.coalesce(F.max("idx"), F.lit(prev_idx))).first()[0]
    after = append_entries(log, request, prev_idx, prev_term)
    return after, {"term": term, "success": True, "match_idx": match, "commit": max(commit, min(leader_commit, match))}
