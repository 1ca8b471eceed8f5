"""Fixed column sets and input schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of the bidirectional-flow CSV format.
BINETFLOW_COLUMNS = [
    "StartTime", "Dur", "Proto", "SrcAddr", "Sport",
    "Dir", "DstAddr", "Dport", "State", "sTos", "dTos",
    "TotPkts", "TotBytes", "SrcBytes", "Label",
]

# The unified flow columns, in output order.
UNIFIED_COLUMNS = [
    "StartTime", "SrcAddr", "Sport", "DstAddr", "Dport", "Proto", "Dur",
    "SrcBytes", "DstBytes", "TotPkts", "Label", "SubLabel", "DatasetSource",
]

# Protocol codes; any other protocol is 99.
PROTOCOL_CODES = {"tcp": 0, "udp": 1, "icmp": 2, "arp": 3}
OTHER_PROTOCOL_CODE = 99

# The fingerprint features, volume group then device group.
BASE_FEATURES = [
    "conn_count", "unique_dst_ips", "unique_dst_ports",
    "proto_entropy", "avg_duration", "avg_bytes", "bytes_per_packet",
    "scan_score", "night_ratio", "burst_score", "src_bytes_ratio",
]
IOT_FEATURES = [
    "device_role_score", "scan_entropy", "c2_beacon_score",
    "protocol_diversity", "iot_port_affinity", "payload_asymmetry",
    "horizontal_scan_flag", "vertical_scan_flag",
]
FEATURES = BASE_FEATURES + IOT_FEATURES

# The per-address profile features, in vector order.
PER_IP_FEATURES = [
    "proto_entropy", "scan_entropy", "c2_beacon_score", "payload_asymmetry",
    "burst_score", "night_ratio", "scan_score", "flow_count", "avg_duration",
    "avg_bytes", "avg_pkts", "tcp_ratio", "udp_ratio", "unique_dst_ports",
    "unique_dst_ips", "avg_sport_entropy", "state_entropy", "bytes_per_pkt", "pkts_per_flow",
]

# Text in, cast later: a bad cell must become a default, never a failed read.
BINETFLOW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in BINETFLOW_COLUMNS])

UNIFIED_TYPES = {
    "StartTime": "timestamp_ntz", "SrcAddr": "string", "Sport": "int", "DstAddr": "string",
    "Dport": "int", "Proto": "string", "Dur": "double", "SrcBytes": "bigint",
    "DstBytes": "bigint", "TotPkts": "bigint", "Label": "int", "SubLabel": "string",
    "DatasetSource": "string",
}

INTEL_ENTRY_TYPE = (
    "map<string,struct<vt_malicious:bigint,vt_suspicious:bigint,abuse_score:bigint,"
    "asn:string,country:string,shodan_ports:string,shodan_tags:string>>"
)
