"""Names of protocol codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import col, hex_id

# fixed values: names given by the protocols' standards
UDS_SERVICES = {
    0x10: "DiagnosticSessionControl", 0x11: "EcuReset", 0x14: "ClearDiagnosticInformation", 0x19: "ReadDtcInformation",
    0x22: "ReadDataByIdentifier", 0x23: "ReadMemoryByAddress", 0x24: "ReadScalingDataByIdentifier", 0x27: "SecurityAccess",
    0x28: "CommunicationControl", 0x29: "Authentication", 0x2A: "ReadDataByPeriodicIdentifier", 0x2C: "DynamicallyDefineDataIdentifier",
    0x2E: "WriteDataByIdentifier", 0x2F: "InputOutputControlByIdentifier", 0x31: "RoutineControl", 0x34: "RequestDownload",
    0x35: "RequestUpload", 0x36: "TransferData", 0x37: "RequestTransferExit", 0x38: "RequestFileTransfer", 0x3D: "WriteMemoryByAddress",
    0x3E: "TesterPresent", 0x83: "AccessTimingParameter", 0x84: "SecuredDataTransmission", 0x85: "ControlDtcSetting",
    0x86: "ResponseOnEvent", 0x87: "LinkControl",
}
UDS_NRCS = {
    0x10: "GeneralReject", 0x11: "ServiceNotSupported", 0x12: "SubFunctionNotSupported", 0x13: "IncorrectMessageLengthOrInvalidFormat",
    0x14: "ResponseTooLong", 0x21: "BusyRepeatRequest", 0x22: "ConditionsNotCorrect", 0x24: "RequestSequenceError",
    0x25: "NoResponseFromSubnetComponent", 0x26: "FailurePreventsExecutionOfRequestedAction", 0x31: "RequestOutOfRange",
    0x33: "SecurityAccessDenied", 0x35: "InvalidKey", 0x36: "ExceededNumberOfAttempts", 0x37: "RequiredTimeDelayNotExpired",
    0x70: "UploadDownloadNotAccepted", 0x71: "TransferDataSuspended", 0x72: "GeneralProgrammingFailure", 0x73: "WrongBlockSequenceCounter",
    0x78: "RequestCorrectlyReceivedResponsePending", 0x7E: "SubFunctionNotSupportedInActiveSession", 0x7F: "ServiceNotSupportedInActiveSession",
}
SOMEIP_TYPES = {
    0x00: "Request", 0x01: "RequestNoReturn", 0x02: "Notification", 0x40: "RequestAck", 0x41: "RequestNoReturnAck",
    0x42: "NotificationAck", 0x80: "Response", 0x81: "Error", 0xC0: "ResponseAck", 0xC1: "ErrorAck",
}
SOMEIP_RETURN_CODES = dict(enumerate(["Ok", "NotOk", "UnknownService", "UnknownMethod", "NotReady", "NotReachable", "Timeout", "WrongProtocolVersion", "WrongInterfaceVersion", "MalformedMessage", "WrongMessageType"]))
DOIP_TYPES = {
    0x0000: "GenericHeaderNegAck", 0x0001: "VehicleIdentRequest", 0x0002: "VehicleIdentRequestWithEid", 0x0003: "VehicleIdentRequestWithVin",
    0x0004: "VehicleAnnouncementResponse", 0x0005: "RoutingActivationRequest", 0x0006: "RoutingActivationResponse", 0x0007: "AliveCheckRequest",
    0x0008: "AliveCheckResponse", 0x4001: "EntityStatusRequest", 0x4002: "EntityStatusResponse", 0x4003: "PowerModeInfoRequest",
    0x4004: "PowerModeInfoResponse", 0x8001: "DiagMessage", 0x8002: "DiagMessagePosAck", 0x8003: "DiagMessageNegAck",
}
IGMP_TYPES = {0x11: "MembershipQuery", 0x12: "V1MembershipReport", 0x16: "V2MembershipReport", 0x17: "LeaveGroup", 0x22: "V3MembershipReport"}
ARP_OPS = {1: "Request", 2: "Reply"}


def named(code, names: dict[int, str], other: Column | str) -> Column:
    """The name of a code; ``other`` for codes without one, NULL for NULL."""
    code = col(code)
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.when(code.isNotNull(), F.coalesce(F.element_at(table, code.cast("int")), other if isinstance(other, Column) else F.lit(other)))


def unknown(code) -> Column:
    """Unknown_0xAA"""
    return F.concat(F.lit("Unknown_"), hex_id(code, 2))


def uds_service(code) -> Column:
    return named(code, UDS_SERVICES, unknown(code))


def uds_nrc(code) -> Column:
    return named(code, UDS_NRCS, unknown(code))


def someip_type(code) -> Column:
    return named(code, SOMEIP_TYPES, unknown(code))


def someip_return_code(code) -> Column:
    return named(code, SOMEIP_RETURN_CODES, unknown(code))


def doip_type(code) -> Column:
    return named(code, DOIP_TYPES, F.concat(F.lit("Unknown_"), hex_id(code, 4)))
