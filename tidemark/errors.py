"""One error type with a code, raised on the driver where arguments can be checked there."""


class TsdbError(Exception):
    """code: invalid_argument, illegal_byte_sequence, not_supported, result_out_of_range, operation_not_permitted,
    file_exists, no_such_file, io_error, or the name of a decoding condition."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
        self.message = message

    def __reduce__(self):
        return TsdbError, (self.code, self.message)
