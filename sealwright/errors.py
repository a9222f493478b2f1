"""Exceptions of the library."""


class AuditError(Exception):
    """Root of the library's exceptions."""


class KeyLoadError(AuditError):
    pass


class LogFormatError(AuditError):
    pass


class SealError(AuditError):
    pass


class RecoveryError(AuditError):
    pass


class VerificationError(AuditError):
    """A log failed verification; ``report`` has the row of the verdict."""

    def __init__(self, compact: str, report=None):
        super().__init__(compact)
        self.report = report


class HmacMismatchError(VerificationError):
    pass


class ChainBreakError(VerificationError):
    pass


class KeyIdMismatchError(VerificationError):
    pass


class RecordCorruptError(VerificationError):
    pass


class HeaderCorruptError(VerificationError):
    pass


class SegmentDiscontinuityError(VerificationError):
    pass


class TimestampRegressionError(VerificationError):
    pass


class TimestampInconsistencyError(VerificationError):
    pass


class UnknownVersionError(VerificationError):
    pass


class MissingRecordError(VerificationError):
    """Kept for callers that catch it; a missing record shows as a ChainBreak."""


class SigningError(AuditError):
    """A remote signer failed; ``retryable`` tells whether another try may succeed."""

    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


BY_KIND = {
    "HmacMismatch": HmacMismatchError,
    "ChainBreak": ChainBreakError,
    "KeyIdMismatch": KeyIdMismatchError,
    "RecordCorrupt": RecordCorruptError,
    "HeaderCorrupt": HeaderCorruptError,
    "SegmentDiscontinuity": SegmentDiscontinuityError,
    "TimestampRegression": TimestampRegressionError,
    "TimestampInconsistency": TimestampInconsistencyError,
    "UnknownVersion": UnknownVersionError,
}
