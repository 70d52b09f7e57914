"""Tables of a case.

``transactions``  txid, first_seen, fee_sats, vsize, script_type
``flows``         txid, direction ('input' or 'output'), ordinal, address, amount_sats
``observations``  id, txid, timestamp, src_ip and the rest of the network fields

Inputs and outputs live in ``flows`` alone, one row each, so that every operator is a plain aggregate or join.
"""

from __future__ import annotations

TRANSACTIONS = "txid string, first_seen timestamp, fee_sats bigint, vsize int, script_type string"
FLOWS = "txid string, direction string, ordinal int, address string, amount_sats bigint"
OBSERVATIONS = "id string, txid string, timestamp timestamp, src_ip string, dst_ip string, src_port int, dst_port int, geo_country string, asn bigint, geo_source string, source_hash string, source_row bigint"
RECORD = "txid string, timestamp timestamp, input_addresses array<string>, input_sats array<bigint>, output_addresses array<string>, output_sats array<bigint>, fee_sats bigint, reported_fee_sats bigint, fee_mismatch_sats bigint, vsize int, script_type string, src_ip string, dst_ip string, src_port int, dst_port int, geo_country string, asn bigint, geo_source string"
SATS = 100_000_000
