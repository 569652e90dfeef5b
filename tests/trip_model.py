"""Row-by-row model of the trip rules, for comparison with the Spark plan on small logs.

A log is a list of ``Row`` in time order; positions are 0-based. Everything is a walk.
"""
from dataclasses import dataclass, field
from datetime import datetime, timezone

from roamlog import fixed

HOUR = 3600


@dataclass
class Row:
    ts: int
    city: str
    category: str
    venue_id: str = ""


@dataclass
class Rules:
    home: str = "H"
    minimum: int = 5
    ends: dict = field(default_factory=dict)
    starts: dict = field(default_factory=dict)
    bicycle: set = field(default_factory=set)
    exclude: set = field(default_factory=set)


def _day(ts):
    return datetime.fromtimestamp(ts, tz=timezone.utc).date()


class Walk:
    def __init__(self, log, rules):
        self.log, self.r = log, rules

    def home(self, i):
        return self.log[i].city == self.r.home

    def abroad(self, i):
        return self.log[i].city not in ("", self.r.home)

    def back(self, first, limit, since, stop):
        """Positions first-1, first-2, ... while after ``limit``, not before ``since``, not at a stop."""
        for i in range(first - 1, limit, -1):
            if self.log[i].ts < since or stop(i):
                return
            yield i

    def ahead(self, last, until):
        for i in range(last + 1, len(self.log)):
            if self.log[i].ts > until:
                return
            yield i

    def runs(self):
        out, begin = [], None
        for i in range(len(self.log) + 1):
            away = i < len(self.log) and not self.home(i)
            if away and begin is None:
                begin = i
            elif not away and begin is not None:
                out.append((begin, i - 1))
                begin = None
        return [x for x in out if x[1] - x[0] + 1 >= max(1, self.r.minimum - 1)]

    def departure(self, fp, prev_end):
        t0 = self.log[fp].ts
        reach = list(self.back(fp, prev_end, t0 - 24 * HOUR, self.abroad))
        hub = None
        for i in reach:
            if not (self.home(i) and self.log[i].category in fixed.TRANSPORT_HUBS):
                continue
            if hub is None:
                hub = i
            elif self.log[i].venue_id and self.log[i].venue_id == self.log[hub].venue_id:
                continue
            elif self.log[hub].ts - self.log[i].ts <= 3 * HOUR:
                hub = i
        if hub is not None:
            return hub
        today = [i for i in reach if _day(self.log[i].ts) == _day(t0)]
        ride = [i for i in today if self.log[i].category in fixed.DEPARTURE_SERVICES]
        fuel = [i for i in today if self.log[i].category == fixed.DEPARTURE_FUEL]
        pick = min(ride) if ride else max(fuel) if fuel else None
        return pick if pick is not None and t0 - self.log[pick].ts <= 4 * HOUR else fp

    def arrival(self, lp):
        until = self.log[lp].ts + 24 * HOUR
        for i in self.ahead(lp, until):
            if self.home(i) and self.log[i].category in fixed.TRANSPORT_HUBS:
                return i, True
        for i in self.ahead(lp, until):
            if self.abroad(i) or (self.home(i) and self.log[i].category == fixed.HOME_CATEGORY):
                break
            if self.home(i) and self.log[i].category == fixed.NEIGHBORHOOD_CATEGORY:
                return i, True
        return lp, False

    def way_home(self, end, found):
        for i in self.ahead(end, self.log[end].ts + (5 if found else 12) * HOUR):
            cat = self.log[i].category
            if (self.abroad(i) and cat not in fixed.ROADSIDE) or cat in fixed.NIGHTLIFE:
                return end
            if self.home(i) and cat == fixed.HOME_CATEGORY:
                return i
        return end

    def bicycle(self, start, prev_end):
        hits = [
            i for i in self.back(start, prev_end, self.log[start].ts - 4 * HOUR, self.abroad)
            if self.home(i) and self.log[i].category in fixed.BICYCLE_START
        ]
        return min(hits) if hits else start

    def trips(self):
        out, prev_end = [], -1
        for fp, lp in self.runs():
            start = self.departure(fp, prev_end)
            end, found = self.arrival(lp)
            key = self.log[start].ts
            if key in self.r.ends:
                end = max([end] + [i for i in range(end, len(self.log)) if self.log[i].ts <= self.r.ends[key]])
            if key in self.r.starts:
                start = min([start] + [i for i in range(start) if self.log[i].ts >= self.r.starts[key]])
            name_ts = self.log[start].ts
            if name_ts in self.r.bicycle:
                start = self.bicycle(start, prev_end)
            end = self.way_home(end, found)
            prev_end = end
            if end - start + 1 >= self.r.minimum and self.log[start].ts not in self.r.exclude:
                out.append((start, end, name_ts))
        return sorted(out, key=lambda x: self.log[x[0]].ts)
