"""Step-by-step restatements to compare the set-based operators with."""

from collections import defaultdict


def pair(messages, rules):
    """Ties and fates of messages (pos, ts, peer, command, inbound), stepping through them."""
    slots = {}  # (peer, rule, direction of the request) -> [pos, ts, replies]
    ties, fates = [], {}

    def drop(key, age):
        pos, _, replies = slots.pop(key)
        rule = rules[key[1]]
        silent = not rule.optional and not replies and (not rule.multi or age > rule.window_ms)
        if replies:
            fates[key[1], pos] = "answered"
        elif silent:
            fates[key[1], pos] = "unanswered_by_us" if key[2] else "unanswered_by_peers"
        else:
            fates[key[1], pos] = "undetermined"

    end = max((m[1] for m in messages), default=0)
    for pos, ts, peer, command, inbound in sorted(messages):
        live = []
        for n, rule in enumerate(rules):
            slot = slots.get((peer, n, not inbound))
            if command in rule.replies and slot and ts - slot[1] <= rule.window_ms:
                live.append((slot[1], n))
        if live:
            n = min(live)[1]
            key = (peer, n, not inbound)
            slot = slots[key]
            ties.append((n, peer, inbound, slot[0], pos, max(ts - slot[1], 0), slot[2] == 0))
            slot[2] += 1
            if not rules[n].multi:
                drop(key, 0)
        for n, rule in enumerate(rules):
            if rule.request == command:
                key = (peer, n, inbound)
                if key in slots:
                    drop(key, ts - slots[key][1])
                slots[key] = [pos, ts, 0]
    for key in list(slots):
        pos, ts, replies = slots[key]
        rule = rules[key[1]]
        if not replies and end - ts <= rule.window_ms:
            fates[key[1], pos] = "undetermined"
            slots.pop(key)
        else:
            drop(key, rule.window_ms + 1)
    return ties, fates


def race(rows):
    """Outcomes of relay rows (item, pos, item_no, ts, peer, delivery, size)."""
    first, announced, delivered = {}, defaultdict(int), defaultdict(int)
    out = []
    for item, pos, no, ts, peer, delivery, size in sorted(rows, key=lambda r: (r[1], r[2])):
        known = item in first
        first.setdefault(item, ts)
        since = max(ts - first[item], 0)
        held = delivery and not delivered[item] and announced[item]
        out.append(
            (
                item, pos, no, not delivery and not known, not delivery and known,
                since if not delivery and known else None,
                bool(delivery and delivered[item]), since if held else None,
            )
        )
        (delivered if delivery else announced)[item] += 1
    return out


def delivery_items(announced, delivered):
    """The hash every delivery counts under; announced (pos, hash), delivered (pos, txid, wtxid)."""
    known = set()
    out = {}
    steps = [(p, 0, h, None) for p, h in announced] + [(p, 1, t, w) for p, t, w in delivered]
    for pos, is_delivery, a, b in sorted(steps, key=lambda s: s[:2]):
        if is_delivery:
            out[pos] = b if a not in known and b in known else a
            known.add(out[pos])
        else:
            known.add(a)
    return out


def keyed(turns, rules):
    """Ties by key of (pos, ts, peer, command, inbound, keys), one queue per key at a time."""
    queues, last, options = defaultdict(list), {}, defaultdict(list)
    for pos, ts, peer, command, inbound, keys in turns:
        for n, rule in enumerate(rules):
            for asks in (True, False):
                if command != rule.request if asks else command not in rule.replies:
                    continue
                for key in keys:
                    name = (peer, n, inbound == asks, key)
                    if name in last and ts - last[name] > rule.window_ms:
                        queues[name] = []
                    last[name] = ts
                    if asks:
                        queues[name].append((ts, pos))
                    elif queues[name]:
                        rts, rpos = queues[name].pop(0)
                        if ts - rts <= rule.window_ms:
                            options[pos].append((rts, n, rpos, ts))
    ties, taken = [], set()
    for pos in sorted(options):
        rts, n, rpos, ts = min(options[pos])
        if rules[n].multi or (rpos, n) not in taken:
            ties.append((rpos, pos, n, max(ts - rts, 0)))
        taken.add((rpos, n))
    return ties
