"""Fixed values of the on-disk format and of the verification rules."""

MAGIC, FORMAT_VERSION = b"OGAU", 1
HEADER_BODY, HEADER_BYTES, FRAME_OVERHEAD = 72, 80, 40
HASH_BYTES, SESSION_BYTES = 32, 16
DEFAULT_SEGMENT_BYTES = 64 << 20
TIME_SLACK_MS = 60_000
CBOR_DEPTH = 16
MAX_SEGMENT_INDEX = 9_999  # file names have four digits
SAMPLE_ROWS = 50
FINALIZE_ACTOR, FINALIZE_EVENT = "system:audit", "segment.finalized"

#: Verification checks in their order; a record's or segment's first failure is the one with the smallest rank.
CHECKS = {
    0: ("HeaderCorrupt", "Truncated"),
    1: ("HeaderCorrupt", "BadMagic"),
    2: ("UnknownVersion", None),
    3: ("HeaderCorrupt", "CrcMismatch"),
    4: ("KeyIdMismatch", None),
    5: ("HeaderCorrupt", "ReservedBytesNonZero"),
    6: ("SegmentDiscontinuity", None),
    7: ("RecordCorrupt", "TornTail"),
    8: ("HmacMismatch", None),
    9: ("RecordCorrupt", "DecodeError"),
    10: ("RecordCorrupt", "DecodeError"),
    11: ("ChainBreak", None),
    12: ("KeyIdMismatch", None),
    13: ("TimestampRegression", None),
    14: ("TimestampInconsistency", None),
}
