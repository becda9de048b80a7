"""Texts that say why a file is rejected. Reports count files by them: fixed values, in the order in which a file meets them."""

# boxes and metadata
BOX_HEADER_CUT = "truncated box header"
LARGE_SIZE_CUT = "truncated largesize"
UUID_CUT = "truncated uuid"
BOX_SIZE = "invalid box size={size} < header_size={header}"
BOX_OVERRUNS = "box overruns parent/file"
META_TOO_SMALL = "meta too small for FullBox fields"
PITM_VERSION = "unsupported pitm version={version}"
IINF_VERSION = "unsupported iinf version={version}"
IINF_CUT = "iinf: ran out of data before reading infe[{i}/{count}]"
IINF_CHILD = "iinf: expected infe box, got '{type}'"
INFE_VERSION = "unsupported infe version={version} (skipping item metadata)"
ILOC_VERSION = "unsupported iloc version={version}"
ILOC_CUT = "read iloc {what} failed"
IPMA_VERSION = "unsupported ipma version={version}"
NO_META = "no top-level 'meta' box found"

# units, headers and tile groups
OBU_FORBIDDEN_BIT = "OBU forbidden bit set"
OBU_WITHOUT_SIZE = "OBU has_size_field=0 (unsupported)"
OBU_EXTENSION_CUT = "truncated OBU extension header"
OBU_SIZE = "failed to read OBU size LEB128"
OBU_OVERRUNS = "OBU payload overruns buffer"
PROFILE = "unsupported seq_profile"
TILE_LIMIT = "tile_{name} exceeds MAX_TILE_{upper}"
CONTEXT_TILE = "invalid context_update_tile_id"
EXISTING_FRAME = "unsupported: show_existing_frame=1"
NOT_A_KEY_FRAME = "unsupported: expected KEY_FRAME with show_frame=1"
REMOVAL_TIME = "unsupported: buffer_removal_time_present_flag=1"
GROUP_BOUNDS = "invalid tg_start/tg_end"
TILE_SIZE_CUT = "truncated tile_size_minus_1"
TILE_OVERRUNS = "tileSize exceeds remaining tile_group payload"
NO_SEQUENCE_HEADER = "no Sequence Header OBU found"
NO_FRAME_HEADER = "no Frame Header OBU found"
GROUP_OVERRUNS = "tile_group header exceeds payload"

# payloads; %d stands for the field's value
EXTENT_INDEX = "extent_index present (unsupported in m1)"
EXTENT_LENGTH = "extent length=0 (unsupported in m1)"
NO_IDAT = "construction_method=1 but no idat box found"
IDAT_OFFSET = "idat extent offset out of range"
IDAT_OVERRUNS = "idat extent overruns idat payload"
EXTENT_OVERRUNS = "extent overruns file"
NO_PRIMARY = "no primary item"
PRIMARY_MISSING = "primary item not found"
PRIMARY_TYPE = "primary item is not a coded 'av01' item"
NO_EXTENTS = "primary item has no iloc extents"
EXTERNAL_DATA = "primary item uses external data_reference_index=%d (unsupported)"
ITEM_BASED = "iloc construction_method=2 (item-based construction) unsupported"
METHOD = "iloc construction_method=%d unsupported"
SEQUENCE_HEADERS = "expected exactly 1 Sequence Header OBU, got {n}"
