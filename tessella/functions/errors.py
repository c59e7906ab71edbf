"""Error codes and messages of the codec."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes, their names and messages.
CODES = {
    0: ("success", "Success"),
    1: ("not_enough_memory", "No memory could be allocated for an internal buffer"),
    2: ("callback_failed", "Callback function returned a failure"),
    3: ("destination_too_small", "The destination buffer is too small to hold all the output"),
    4: ("need_more_data", "The source buffer is too small, more input data was expected"),
    5: ("invalid_data", "Invalid JPEG-LS stream, the encoded bit stream contains a general structural problem"),
    6: ("encoding_not_supported", "Invalid JPEG-LS stream: the JPEG stream is not encoded with the JPEG-LS algorithm"),
    7: ("parameter_value_not_supported", "The JPEG-LS stream is encoded with a parameter value that is not supported by the this decoder"),
    8: ("color_transform_not_supported", "The HP color transform is not supported"),
    9: ("jpegls_preset_extended_parameter_type_not_supported", "Unsupported JPEG-LS stream: JPEG-LS preset parameters segment contains a JPEG-LS Extended (ISO/IEC 14495-2) type"),
    10: ("jpeg_marker_start_byte_not_found", "Invalid JPEG-LS stream: the leading start byte (0xFF) for a JPEG marker was not found"),
    11: ("start_of_image_marker_not_found", "Invalid JPEG-LS stream: first JPEG marker is not a Start Of Image (SOI) marker"),
    12: ("invalid_spiff_header", "Invalid JPEG-LS stream: invalid SPIFF header"),
    13: ("unknown_jpeg_marker_found", "Invalid JPEG-LS stream: an unknown JPEG marker code was found"),
    14: ("unexpected_start_of_scan_marker", "Invalid JPEG-LS stream: unexpected Start Of Scan (SOS) marker found"),
    15: ("invalid_marker_segment_size", "Invalid JPEG-LS stream: segment size of a marker segment is invalid"),
    16: ("duplicate_start_of_image_marker", "Invalid JPEG-LS stream: more then one Start Of Image (SOI) marker"),
    17: ("duplicate_start_of_frame_marker", "Invalid JPEG-LS stream: more then one Start Of Frame (SOF) marker"),
    18: ("duplicate_component_id_in_sof_segment", "Invalid JPEG-LS stream: duplicate component identifier in the (SOF) segment"),
    19: ("unexpected_end_of_image_marker", "Invalid JPEG-LS stream: unexpected End Of Image (EOI) marker"),
    20: ("invalid_jpegls_preset_parameter_type", "Invalid JPEG-LS stream: JPEG-LS preset parameters segment contains an invalid type"),
    21: ("missing_end_of_spiff_directory", "Invalid JPEG-LS stream: SPIFF header without End Of Directory (EOD) entry"),
    22: ("unexpected_restart_marker", "Invalid JPEG-LS stream: restart (RTSm) marker found outside encoded entropy data"),
    23: ("restart_marker_not_found", "Invalid JPEG-LS stream: missing expected restart (RTSm) marker"),
    24: ("end_of_image_marker_not_found", "Invalid JPEG-LS stream: missing End Of Image (EOI) marker"),
    25: ("unexpected_define_number_of_lines_marker", "Invalid JPEG-LS stream: unexpected Define Number of Lines (DNL) marker"),
    26: ("define_number_of_lines_marker_not_found", "Invalid JPEG-LS stream: missing expected Define Number of Lines (DNL) marker"),
    27: ("unknown_component_id", "Invalid JPEG-LS stream: unknown component ID in scan segment"),
    28: ("abbreviated_format_and_spiff_header_mismatch", "Invalid JPEG-LS stream: mapping tables without SOF but with spiff header"),
    29: ("invalid_parameter_width", "Invalid JPEG-LS stream: the width (Number of samples per line) is already defined"),
    30: ("invalid_parameter_height", "Invalid JPEG-LS stream: the height (Number of lines) is already defined"),
    31: ("invalid_parameter_bits_per_sample", "Invalid JPEG-LS stream: the bit per sample (sample precision) parameter is not in the range [2, 16]"),
    32: ("invalid_parameter_component_count", "Invalid JPEG-LS stream: component count in the SOF segment is outside the range [1, 255]"),
    33: ("invalid_parameter_interleave_mode", "Invalid JPEG-LS stream: interleave mode is outside the range [0, 2] or conflicts with component count"),
    34: ("invalid_parameter_near_lossless", "Invalid JPEG-LS stream: near-lossless is outside the range [0, min(255, MAXVAL/2)]"),
    35: ("invalid_parameter_jpegls_preset_parameters", "Invalid JPEG-LS stream: JPEG-LS preset parameters segment contains invalid values"),
    36: ("invalid_parameter_color_transformation", "Invalid JPEG-LS stream: Color transformation segment contains invalid values or frame info mismatch"),
    37: ("invalid_parameter_mapping_table_id", "Invalid JPEG-LS stream: mapping table ID outside valid range or duplicate"),
    38: ("invalid_parameter_mapping_table_continuation", "Invalid JPEG-LS stream: mapping table continuation without matching mapping table specification"),
    100: ("invalid_operation", "Method call is invalid for the current state"),
    101: ("invalid_argument", "Invalid argument"),
    102: ("invalid_argument_width", "The width argument is outside the supported range [1, 4294967295]"),
    103: ("invalid_argument_height", "The height argument is outside the supported range [1, 4294967295]"),
    104: ("invalid_argument_bits_per_sample", "The bit per sample argument is outside the range [2, 16]"),
    105: ("invalid_argument_component_count", "The component count argument is outside the range [1, 255]"),
    106: ("invalid_argument_interleave_mode", "The interleave mode is not None, Sample, Line or invalid in combination with component count"),
    107: ("invalid_argument_near_lossless", "The near lossless argument is outside the range [0, min(255, MAXVAL/2)]"),
    108: ("invalid_argument_jpegls_pc_parameters", "The argument for the JPEG-LS preset coding parameters is not valid"),
    109: ("invalid_argument_color_transformation", "The argument for the color component is not (None, Hp1, Hp2, Hp3) or invalid in combination with component count"),
    110: ("invalid_argument_size", "The passed size is outside the valid range"),
    111: ("invalid_argument_stride", "The stride argument does not match with the frame info and buffer size"),
    112: ("invalid_argument_encoding_options", "The encoding options argument has an invalid value"),
}
UNKNOWN = "Unknown"
NUMBER = {name: code for code, (name, _) in CODES.items()}


class JlsError(ValueError):
    """A codec failure with its code."""

    def __init__(self, name: str):
        self.errc = NUMBER[name]
        super().__init__(CODES[self.errc][1])

    def __reduce__(self):
        return JlsError, (CODES[self.errc][0],)


def error_message(errc: Column) -> Column:
    """The message of a code; Unknown for others, null for null."""
    table = F.create_map(*[F.lit(x) for code, (_, message) in CODES.items() for x in (code, message)])
    return F.when(errc.isNotNull(), F.coalesce(F.try_element_at(table, errc.cast("int")), F.lit(UNKNOWN)))
