"""Fixed values that decide results, in one place.

Everything here is a published constant of the media-library domain: platform
keys, file extensions, region and language words, scoring weights. Results
are only right when these match exactly, so they are stated as plain text.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Platforms and their file formats, in tie-break order.
# Platform line:      key | name | manufacturer | category
# Indented lines:     extension | format name | format type | priority | flags
# ---------------------------------------------------------------------------
PLATFORM_TABLE = """
NES | Nintendo Entertainment System | Nintendo | Console
    .nes | iNES | CartridgeImage | 100
    .unf | UNIF | CartridgeImage | 90
    .unif | UNIF | CartridgeImage | 90
FDS | Famicom Disk System | Nintendo | Console
    .fds | FDS image | FloppyImage | 100
GB | Game Boy | Nintendo | Handheld
    .gb | Game Boy ROM | CartridgeImage | 100
GBC | Game Boy Color | Nintendo | Handheld
    .gbc | Game Boy Color ROM | CartridgeImage | 100
SNES | Super Nintendo | Nintendo | Console
    .sfc | SNES ROM | CartridgeImage | 100
    .smc | SNES copier image | CartridgeImage | 95
N64 | Nintendo 64 | Nintendo | Console
    .z64 | Big-endian ROM | CartridgeImage | 100
    .n64 | Little-endian ROM | CartridgeImage | 100
    .v64 | Byte-swapped ROM | CartridgeImage | 100
GBA | Game Boy Advance | Nintendo | Handheld
    .gba | GBA ROM | CartridgeImage | 100
NDS | Nintendo DS | Nintendo | Handheld
    .nds | NDS ROM | CartridgeImage | 100
3DS | Nintendo 3DS | Nintendo | Handheld
    .3ds | 3DS image | CartridgeImage | 100
    .cia | CTR importable archive | Package | 100
GC | GameCube | Nintendo | Console
    .gcm | GameCube image | DiscImage | 100
    .rvz | Dolphin RVZ | DiscImage | 70
    .gcz | Dolphin GCZ | DiscImage | 70
    .iso | GameCube ISO | DiscImage | 55
WII | Wii | Nintendo | Console
    .wbfs | WBFS image | DiscImage | 100
    .wia | Wii image archive | DiscImage | 100
    .rvz | Dolphin RVZ | DiscImage | 75
    .iso | Wii ISO | DiscImage | 50
GENESIS | Genesis / Mega Drive | Sega | Console
    .md | Mega Drive ROM | CartridgeImage | 100
    .gen | Genesis ROM | CartridgeImage | 100
    .smd | Interleaved ROM | CartridgeImage | 100
    .bin | Genesis binary | CartridgeImage | 20
SMS | Master System | Sega | Console
    .sms | Master System ROM | CartridgeImage | 100
GG | Game Gear | Sega | Handheld
    .gg | Game Gear ROM | CartridgeImage | 100
SATURN | Sega Saturn | Sega | Console
    .cue | CUE sheet | MultiFileDisc | 65 | multi-file
    .chd | CHD | DiscImage | 60
    .iso | ISO | DiscImage | 40
    .bin | Track binary | DiscImage | 15
DREAMCAST | Dreamcast | Sega | Console
    .gdi | GD-ROM descriptor | MultiFileDisc | 100 | multi-file
    .cdi | DiscJuggler image | DiscImage | 100
    .cue | CUE sheet | MultiFileDisc | 60 | multi-file
    .chd | CHD | DiscImage | 65
    .bin | Track binary | DiscImage | 15
PSX | PlayStation | Sony | Console
    .cue | CUE sheet | MultiFileDisc | 80 | multi-file
    .pbp | PlayStation package | Package | 100
    .chd | CHD | DiscImage | 75
    .iso | ISO | DiscImage | 60
    .bin | Track binary | DiscImage | 15
PS2 | PlayStation 2 | Sony | Console
    .iso | PS2 ISO | DiscImage | 80
    .chd | CHD | DiscImage | 70
    .cso | Compressed ISO | DiscImage | 70
PSP | PlayStation Portable | Sony | Handheld
    .iso | PSP ISO | DiscImage | 75
    .cso | Compressed ISO | DiscImage | 90
    .pbp | EBOOT package | Package | 80
XBOX | Xbox | Microsoft | Console
    .iso | Xbox ISO | DiscImage | 45
ATARI2600 | Atari 2600 | Atari | Console
    .a26 | Atari 2600 ROM | CartridgeImage | 100
LYNX | Atari Lynx | Atari | Handheld
    .lnx | Lynx ROM | CartridgeImage | 100
JAGUAR | Atari Jaguar | Atari | Console
    .j64 | Jaguar ROM | CartridgeImage | 100
    .jag | Jaguar ROM | CartridgeImage | 100
PCE | PC Engine / TurboGrafx-16 | NEC / Hudson | Console
    .pce | PC Engine ROM | CartridgeImage | 100
NGP | Neo Geo Pocket | SNK | Handheld
    .ngp | NGP ROM | CartridgeImage | 100
    .ngc | NGPC ROM | CartridgeImage | 100
MAME | MAME | Arcade | Arcade
    .zip | MAME ROM set | ArcadeSet | 35 | archive
    .7z | MAME ROM set | ArcadeSet | 35 | archive
    .chd | Arcade CHD | DiscImage | 45
C64 | Commodore 64 | Commodore | Computer
    .d64 | 1541 disk image | FloppyImage | 100
    .t64 | Tape image | TapeImage | 100
    .prg | Program | Rom | 80
AMIGA | Amiga | Commodore | Computer
    .adf | Amiga disk file | FloppyImage | 100
    .hdf | Hard disk file | DiscImage | 75
DOS | DOS | IBM PC | Computer
    .zip | DOS archive | Archive | 10 | archive
DSI | Nintendo DSi | Nintendo | Handheld
    .dsi | DSi application | Package | 100
    .nds | DSi-enhanced ROM | CartridgeImage | 40 | header-check
N64DD | Nintendo 64DD | Nintendo | Console
    .ndd | 64DD disk image | DiscImage | 100
WIIU | Wii U | Nintendo | Console
    .wud | Wii U disc | DiscImage | 100
    .wux | Compressed Wii U disc | DiscImage | 100
    .rpx | Wii U executable | Package | 100
SWITCH | Nintendo Switch | Nintendo | Console
    .xci | NX card image | CartridgeImage | 100
    .nsp | Nintendo submission package | Package | 100
    .nca | Nintendo content archive | Package | 100
SG1000 | SG-1000 | Sega | Console
    .sg | SG-1000 ROM | CartridgeImage | 100
SEGACD | Sega CD / Mega CD | Sega | Console
    .cue | CUE sheet | MultiFileDisc | 65 | multi-file
    .chd | CHD | DiscImage | 60
    .bin | Track binary | DiscImage | 15
32X | Sega 32X | Sega | Console
    .32x | 32X ROM | CartridgeImage | 100
PS3 | PlayStation 3 | Sony | Console
    .pkg | PlayStation package | Package | 65
    .iso | PS3 ISO | DiscImage | 65
    .ps3dir | RPCS3 game folder | DirectoryGame | 65
VITA | PlayStation Vita | Sony | Handheld
    .vpk | Vita package | Package | 100
    .pkg | PlayStation package | Package | 70
XBOX360 | Xbox 360 | Microsoft | Console
    .iso | Xbox 360 ISO | DiscImage | 55
    .xex | Xbox executable | Package | 100
XBOXONE | Xbox One / Series | Microsoft | Console
    .xvc | Xbox virtual cartridge | Package | 100
ATARI5200 | Atari 5200 | Atari | Console
    .a52 | Atari 5200 ROM | CartridgeImage | 100
ATARI7800 | Atari 7800 | Atari | Console
    .a78 | Atari 7800 ROM | CartridgeImage | 100
JAGCD | Jaguar CD | Atari | Console
    .cue | CUE sheet | MultiFileDisc | 45 | multi-file
    .chd | CHD | DiscImage | 45
    .bin | Track binary | DiscImage | 15
SUPERGRAFX | SuperGrafx | NEC / Hudson | Console
    .pce | SuperGrafx ROM | CartridgeImage | 60 | header-check
PCECD | PC Engine CD | NEC / Hudson | Console
    .cue | CUE sheet | MultiFileDisc | 55 | multi-file
    .chd | CHD | DiscImage | 55
    .bin | Track binary | DiscImage | 15
NEOGEO | Neo Geo | SNK | Console
    .neo | Neo Geo ROM | CartridgeImage | 100
    .zip | Neo Geo set | Archive | 30 | archive
NEOGEOCD | Neo Geo CD | SNK | Console
    .cue | CUE sheet | MultiFileDisc | 55 | multi-file
    .chd | CHD | DiscImage | 55
    .bin | Track binary | DiscImage | 15
3DO | 3DO | The 3DO Company | Console
    .iso | 3DO ISO | DiscImage | 45
    .cue | CUE sheet | MultiFileDisc | 45 | multi-file
    .chd | CHD | DiscImage | 45
    .bin | Track binary | DiscImage | 15
CDI | CD-i | Philips | Console
    .cue | CUE sheet | MultiFileDisc | 40 | multi-file
    .chd | CHD | DiscImage | 40
    .bin | Track binary | DiscImage | 15
CD32 | Amiga CD32 | Commodore | Console
    .cue | CUE sheet | MultiFileDisc | 40 | multi-file
    .chd | CHD | DiscImage | 40
    .bin | Track binary | DiscImage | 15
ZX | ZX Spectrum | Sinclair | Computer
    .tzx | TZX tape | TapeImage | 100
    .tap | Tape image | TapeImage | 70
    .z80 | Snapshot | Rom | 100
CPC | Amstrad CPC | Amstrad | Computer
    .dsk | CPC disk | FloppyImage | 60
    .cdt | CPC tape | TapeImage | 100
MSX | MSX / MSX2 | ASCII / Microsoft | Computer
    .rom | MSX ROM | CartridgeImage | 60
    .dsk | MSX disk | FloppyImage | 55
ATARIST | Atari ST | Atari | Computer
    .st | ST disk | FloppyImage | 100
    .msa | Magic Shadow Archiver | FloppyImage | 100
ATARI8 | Atari 8-bit | Atari | Computer
    .atr | Atari disk | FloppyImage | 100
    .xex | Atari executable | Rom | 50
APPLE2 | Apple II | Apple | Computer
    .woz | WOZ disk | FloppyImage | 100
    .dsk | Apple disk | FloppyImage | 50
PC98 | PC-98 | NEC | Computer
    .hdi | Hard disk image | DiscImage | 100
    .fdi | Floppy image | FloppyImage | 100
X68000 | Sharp X68000 | Sharp | Computer
    .dim | Disk image | FloppyImage | 100
    .xdf | XDF disk | FloppyImage | 100
FMTOWNS | FM Towns | Fujitsu | Computer
    .fmt | FM Towns disk | FloppyImage | 100
    .cue | CUE sheet | MultiFileDisc | 35 | multi-file
    .bin | Track binary | DiscImage | 10
FBNEO | FinalBurn Neo | Arcade | Arcade
    .zip | FBNeo ROM set | ArcadeSet | 30 | archive
    .7z | FBNeo ROM set | ArcadeSet | 30 | archive
UNKNOWN | Unassigned / Unknown | Unknown | Other
    .zip | ZIP archive | Archive | 1 | archive
    .7z | 7-Zip archive | Archive | 1 | archive
    .rar | RAR archive | Archive | 1 | archive
"""

# ---------------------------------------------------------------------------
# Platforms that have a published checksum catalog.
# key | catalog folder | catalog file name | display source
# ---------------------------------------------------------------------------
CATALOG_TABLE = """
NES | no-intro | Nintendo - Nintendo Entertainment System.dat | Libretro / No-Intro
FDS | no-intro | Nintendo - Family Computer Disk System.dat | Libretro / No-Intro
GB | no-intro | Nintendo - Game Boy.dat | Libretro / No-Intro
GBC | no-intro | Nintendo - Game Boy Color.dat | Libretro / No-Intro
SNES | no-intro | Nintendo - Super Nintendo Entertainment System.dat | Libretro / No-Intro
N64 | no-intro | Nintendo - Nintendo 64.dat | Libretro / No-Intro
N64DD | no-intro | Nintendo - Nintendo 64DD.dat | Libretro / No-Intro
GBA | no-intro | Nintendo - Game Boy Advance.dat | Libretro / No-Intro
NDS | no-intro | Nintendo - Nintendo DS.dat | Libretro / No-Intro
DSI | no-intro | Nintendo - Nintendo DSi.dat | Libretro / No-Intro
3DS | no-intro | Nintendo - Nintendo 3DS.dat | Libretro / No-Intro
GC | redump | Nintendo - GameCube.dat | Libretro / Redump
WII | redump | Nintendo - Wii.dat | Libretro / Redump
GENESIS | no-intro | Sega - Mega Drive - Genesis.dat | Libretro / No-Intro
SMS | no-intro | Sega - Master System - Mark III.dat | Libretro / No-Intro
GG | no-intro | Sega - Game Gear.dat | Libretro / No-Intro
SG1000 | no-intro | Sega - SG-1000.dat | Libretro / No-Intro
32X | no-intro | Sega - 32X.dat | Libretro / No-Intro
SATURN | redump | Sega - Saturn.dat | Libretro / Redump
DREAMCAST | redump | Sega - Dreamcast.dat | Libretro / Redump
SEGACD | redump | Sega - Mega-CD - Sega CD.dat | Libretro / Redump
PSX | redump | Sony - PlayStation.dat | Libretro / Redump
PS2 | redump | Sony - PlayStation 2.dat | Libretro / Redump
PSP | redump | Sony - PlayStation Portable.dat | Libretro / Redump
PS3 | redump | Sony - PlayStation 3.dat | Libretro / Redump
XBOX | redump | Microsoft - Xbox.dat | Libretro / Redump
XBOX360 | redump | Microsoft - Xbox 360.dat | Libretro / Redump
ATARI2600 | no-intro | Atari - 2600.dat | Libretro / No-Intro
ATARI5200 | no-intro | Atari - 5200.dat | Libretro / No-Intro
ATARI7800 | no-intro | Atari - 7800.dat | Libretro / No-Intro
LYNX | no-intro | Atari - Lynx.dat | Libretro / No-Intro
JAGUAR | no-intro | Atari - Jaguar.dat | Libretro / No-Intro
JAGCD | redump | Atari - Jaguar CD.dat | Libretro / Redump
PCE | no-intro | NEC - PC Engine - TurboGrafx 16.dat | Libretro / No-Intro
SUPERGRAFX | no-intro | NEC - PC Engine SuperGrafx.dat | Libretro / No-Intro
PCECD | redump | NEC - PC Engine CD - TurboGrafx-CD.dat | Libretro / Redump
NGP | no-intro | SNK - Neo Geo Pocket.dat | Libretro / No-Intro
NEOGEOCD | redump | SNK - Neo Geo CD.dat | Libretro / Redump
3DO | redump | The 3DO Company - 3DO.dat | Libretro / Redump
CDI | redump | Philips - CD-i.dat | Libretro / Redump
CD32 | redump | Commodore - CD32.dat | Libretro / Redump
C64 | no-intro | Commodore - 64.dat | Libretro / No-Intro
AMIGA | no-intro | Commodore - Amiga.dat | Libretro / No-Intro
MSX | no-intro | Microsoft - MSX.dat | Libretro / No-Intro
ATARIST | no-intro | Atari - ST.dat | Libretro / No-Intro
ATARI8 | no-intro | Atari - 8-bit Family.dat | Libretro / No-Intro
"""

# Words recognised inside (...) and [...] name tags.
REGIONS = ["USA", "Europe", "Japan", "World", "Australia", "Asia", "Brazil",
           "Canada", "China", "France", "Germany", "Italy", "Korea", "Spain"]
LANGUAGES = {"En": "English", "Ja": "Japanese", "Fr": "French", "De": "German",
             "Es": "Spanish", "It": "Italian", "Pt": "Portuguese",
             "Ko": "Korean", "Zh": "Chinese"}

# Enumerations stored as text.
FILE_STATUSES = ["Normal", "Duplicate", "Missing", "Changed", "Unsupported",
                 "Corrupt", "Unverified", "Grouped"]
CATALOG_STATUSES = ["Unknown", "Verified", "NoMatch", "Unsupported", "Error"]
VIEW_FILTERS = ["All", "Verified", "Unverified", "ExactDuplicates",
                "MultipleVersions", "Missing", "NeedsReview",
                "PreferredCopies", "Wanted"]

# Identification scores and confidences.
SCORE_PATH_SEGMENT = 100
SCORE_KEY_TOKEN = 90
SCORE_SYSTEM_NAME = 75
SCORE_SINGLE_CANDIDATE = 50
CONFIDENCE_SINGLE = 0.95
CONFIDENCE_CLEAR = 0.8
CONFIDENCE_TIE = 0.5
ARCHIVE_CONFIDENCE_BONUS = 0.03
ARCHIVE_CONFIDENCE_CAP = 0.98
ARCHIVE_EXTENSIONS = [".zip", ".7z", ".rar"]
REVIEW_CONFIDENCE = 0.75

# Preference scores.
SCORE_INELIGIBLE = -10000
SCORE_MANUAL = 5000
SCORE_VERIFIED = 1000
SCORE_TOP_REGION = 120
SCORE_EUROPE = 80
SCORE_JAPAN = 40
SCORE_REVISION = 10
SCORE_UNFINISHED = -300
SCORE_CORRUPT = -1000
SCORE_ZIP = 5
TOP_REGION_TAGS = ["(USA)", "(World)"]
UNFINISHED_TAGS = ["(Beta", "(Proto", "(Demo", "(Sample", "[b", "(Pirate", "(Hack"]

# Hashing, fuzzy matching, clean-up and naming limits.
QUICK_HASH_SAMPLE = 64 * 1024
FUZZY_MIN_SIMILARITY = 0.85
FUZZY_TOP = 300
RANK_PREFIX_MIN_TITLES = 5
PACKAGE_EXTENSION = ".ps3dir"
PACKAGE_MARKER = "PARAM.SFO"
PACKAGE_SUBFOLDER = "PS3_GAME"
FOLDER_FORBIDDEN = '"<>|:*?\\/'          # plus the control characters 0-31
ARTWORK_FORBIDDEN = '&*/:`<>?\\|"'
