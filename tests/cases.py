"""Cases for tests: actors who save, sell, drain or mirror, as observation records."""

import random
from datetime import UTC, datetime, timedelta

START = {"train": datetime(2021, 3, 1, tzinfo=UTC), "calibration": datetime(2022, 3, 1, tzinfo=UTC), "test": datetime(2023, 3, 1, tzinfo=UTC)}
#: Kind: spends, seconds between them, outputs, sources that relay each; the last two kinds are the positives.
KINDS = {"saver": (5, 40_000, 2, 1), "seller": (7, 9_000, 9, 2), "drain": (16, 20, 14, 1), "mirror": (9, 5_000, 4, 11)}


def coins(sats):
    return f"{sats // 10**8}.{sats % 10**8:08d}"


def made(split, actors):
    """(records, labels): each actor has one wallet that spends; labels are (address, label, scenario, entity_id)."""
    rng, records, labels = random.Random(split), [], []
    for i in range(actors):
        positive = i % 5 == 4
        kind = rng.choice(["drain", "mirror"] if positive else ["saver", "seller"])
        spends, pause, outs, relays = KINDS[kind]
        wallet, now = f"{split}.{i}", START[split] + timedelta(minutes=7 * i)
        labels.append((wallet, int(positive), kind, f"{split}/{i}"))
        for s in range(spends):
            now += timedelta(seconds=rng.uniform(0.7, 1.3) * pause)
            parts = [rng.randrange(20_000, 900_000) for _ in range(outs)]
            if kind == "mirror":
                parts = [parts[0]] * outs
            fee = rng.randrange(200, 900)
            one = {
                "txid": f"{rng.getrandbits(256):064x}", "input_addresses": [wallet], "input_amounts": [coins(sum(parts) + fee)], "output_addresses": [f"{wallet}.{s}.{o}" for o in range(outs)], "output_amounts": [coins(p) for p in parts],
                "fee": coins(fee), "vsize": 100 + 34 * outs, "script_type": "p2tr", "dst_ip": "192.0.2.9", "dst_port": 8333,
            }
            for r in range(relays):
                seen = now + timedelta(milliseconds=90 * r)
                records.append(one | {"timestamp": seen.isoformat(timespec="microseconds"), "src_ip": f"192.0.2.{10 + (i * 3 + r) % 200}", "src_port": 20_000 + r})
    return records, labels
