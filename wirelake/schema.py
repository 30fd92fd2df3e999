"""Column contracts of the tables, as DDL."""

LOG_COLUMNS = (
    "timestamp_ns long, message_type string, channel int, can_id long, is_ext_id boolean, dir byte, rtr boolean, dlc byte, data binary, "
    "fdf boolean, brs boolean, esi boolean, src_addr binary, dst_addr binary, ether_type int, vlan_tpid int, vlan_cos int, vlan_id int, "
    "mf4_group string, mf4_name string, mf4_value double, mf4_unit string"
)
#: What the log sources yield: the log columns with the file, the recording's
#: start (0 where unknown) and the row's position in the file.
SOURCE_ROWS = f"_source_file string, start_ns long, row_in_file long, {LOG_COLUMNS}"

UDS_COLUMNS = "transport string, doip_src_addr int, doip_target_addr int, uds_type string, service_id int, service_name string, nrc int, nrc_name string"

BRONZE = f"_source_file string, _file_mtime timestamp, _file_size_bytes long, _ingested_at timestamp, timestamp_ns long, event_time timestamp, {LOG_COLUMNS.split(', ', 1)[1]}, {UDS_COLUMNS}"

CAN_DEFS = "message_id long, signal_name string, start_bit int, bit_length int, byte_order string, is_signed boolean, scale double, offset double, pdu_id long"
SOMEIP_DEFS = "service_id int, method_id int, signal_name string, start_bit int, bit_length int, byte_order string, is_signed boolean, scale double, offset double"
ENUMS = "signal_name string, raw_value decimal(20,0), category string"
CHANNELS = "type string, channel int, name string"

GOLD = "_source_file string, _ingested_at timestamp, message_type string, timestamp_ns long, timestamp_s double, event_time timestamp, channel int, signal_source string, message_id_str string, dir string, signal_name string, signal_value double, signal_str string"


def names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]
