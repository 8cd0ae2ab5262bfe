"""An archive of events, and every question it can be asked."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.functions.jsonview import event_json
from tallywire.operators import networks as net
from tallywire.operators import pairing, peers, raster, relay, search, timeline
from tallywire.operators.keyed import conversation
from tallywire.operators.rules import WIRE_RULES, Rule
from tallywire.plans.sizes import settled
from tallywire.sources import archive as source


class Archive:
    """Questions over one table of classified events; every answer is a lazy DataFrame.

    Several questions read the same events: cache ``events`` first if they fit the cluster.
    """

    def __init__(
        self,
        events: DataFrame,
        bad: DataFrame | None = None,
        files: DataFrame | None = None,
        rules: Sequence[Rule] = WIRE_RULES,
        damaged: Callable[[], DataFrame] | None = None,
    ):
        self.events, self.bad, self.files, self.rules = events, bad, files, tuple(rules)
        self._find_damaged = damaged
        self.prefixes: DataFrame | None = None

    @classmethod
    def open(
        cls,
        spark: SparkSession,
        path: str | list[str],
        fmt: str = "parquet",
        rules: Sequence[Rule] = WIRE_RULES,
    ) -> Archive:
        """Read the files below ``path`` as one archive."""
        raw = source.read_raw(spark, path, fmt)
        good, bad = source.quarantine(raw)
        files = source.list_files(spark, path)
        events = source.classify(source.with_archive_order(good, files))
        listed = files.join(source.file_headers(raw), "file_path", "left")
        damaged = lambda: source.damaged_files(spark, path, fmt, files)
        return cls(events, bad, listed, rules, damaged)

    @cached_property
    def peer_table(self) -> DataFrame:
        return peers.peer_table(self.events)

    @cached_property
    def index(self) -> DataFrame:
        """The seek index of the events, counted and written at its first use."""
        return settled(search.seek_index(self.events), "seek-index")

    @cached_property
    def agents(self) -> DataFrame:
        return peers.peer_agents(self.events, self.peer_table)

    @cached_property
    def _tallies(self) -> DataFrame:
        return relay.relay_tallies(relay.race_of_events(self.events))

    def file_summary(self) -> DataFrame:
        if self.files is None or self.bad is None:
            raise ValueError("only an archive opened from files knows them")
        damaged = self._find_damaged() if self._find_damaged else None
        return source.file_summary(self.events, self.bad, self.files, damaged)

    def totals(self) -> DataFrame:
        return timeline.totals(self.events, self.bad)

    def breakdown(self) -> DataFrame:
        return timeline.breakdown(self.events)

    def timeline(self, bins: int) -> DataFrame:
        return timeline.timeline_groups(self.events, bins)

    def timeline_group(self, group: str, bins: int) -> DataFrame:
        return timeline.timeline_group(self.events, group, bins)

    def groups_present(self) -> DataFrame:
        return timeline.groups_present(self.events)

    def peers(
        self, sort: str = "id", descending: bool = False, offset: int = 0, limit: int = 100
    ) -> DataFrame:
        named = peers.with_agents(self.peer_table, self.agents)
        return peers.peers_page(named, sort, descending, offset, limit)

    def peer_detail(self, peer_id: int) -> DataFrame:
        card = relay.relay_scorecard(self._tallies)
        return peers.peer_detail(self.events, peer_id, self.agents, card)

    def query(self, offset: int = 0, limit: int = 100, **conditions) -> DataFrame:
        if set(conditions) <= {"kinds", "groups"}:
            cut = search.seek(self.events, self.index, offset, limit, **conditions)
        else:
            cut = search.page(self.search(**conditions), offset, limit)
        return search.page_rows(self.events, cut, limit)

    def search(self, **conditions) -> DataFrame:
        return search.search_events(self.events, **conditions)

    def query_total(self, **conditions) -> DataFrame:
        return search.total(self.search(**conditions))

    def sequence(self, offset: int = 0, limit: int = 100, **conditions) -> DataFrame:
        return conversation(self.events, self.search(**conditions), offset, limit, self.rules)

    def user_agents(self, limit: int | None = None) -> DataFrame:
        return peers.agent_census(peers.with_agents(self.peer_table, self.agents), limit)

    def user_agent_totals(self) -> DataFrame:
        return peers.agent_totals(peers.with_agents(self.peer_table, self.agents))

    def connection_durations(self, ending: str = "all") -> DataFrame:
        return peers.connection_durations(self.events, ending)

    def peer_raster(self, peer_id: int, columns: int, rows: int) -> DataFrame:
        return raster.peer_raster(self.events, peer_id, columns, rows)

    def peer_marks(self, peer_id: int, columns: int) -> DataFrame:
        return raster.peer_marks(self.events, peer_id, columns)

    def peer_activity(self, columns: int, max_rows: int, **options) -> DataFrame:
        return raster.peer_activity(
            self.events, self.peer_table, columns=columns, max_rows=max_rows, **options
        )

    def raster_marks(self, columns: int, **window) -> DataFrame:
        return raster.raster_marks(self.events, columns, **window)

    def relay(
        self, sort: str = "first", descending: bool = True, limit: int | None = None
    ) -> DataFrame:
        card = relay.relay_scorecard(self._tallies)
        best = relay.sorted_scorecard(card, sort, descending, limit)
        return relay.sorted_scorecard(
            relay.with_peer_identity(best, self.peer_table), sort, descending
        )

    def relay_totals(self) -> DataFrame:
        return relay.relay_totals(self._tallies)

    def relay_distributions(self) -> DataFrame:
        return relay.relay_distributions(self._tallies)

    def exchanges(self) -> DataFrame:
        captured = pairing.replies_captured(self.events, self.rules).drop("request")
        return pairing.exchange_report(self.events, self.rules).join(captured, "rule")

    def unanswered_is_meaningful(self) -> DataFrame:
        return pairing.unanswered_is_meaningful(
            pairing.exchange_report(self.events, self.rules),
            pairing.replies_captured(self.events, self.rules),
        )

    def load_prefixes(self, prefixes: DataFrame) -> None:
        """The table (prefix, asn) the network questions need."""
        self.prefixes = prefixes

    def _placed(self) -> DataFrame:
        if self.prefixes is None:
            raise ValueError("load a prefix table first")
        return net.with_network(self.peer_table, self.prefixes)

    def networks(self, offset: int = 0, limit: int = 100) -> DataFrame:
        return net.networks_page(net.networks(self._placed()), offset, limit)

    def networks_total(self) -> DataFrame:
        return net.networks_total(net.networks(self._placed()))

    def network_peers(self, asn: int | None = None, label: str = "", limit: int = 100) -> DataFrame:
        return net.network_peers(self._placed(), asn, label, limit)

    def event_json(self, pos: int) -> DataFrame:
        """The full event at one archive position as JSON text."""
        return event_json(self.events.filter(F.col("pos") == pos)).select("pos", "json")
