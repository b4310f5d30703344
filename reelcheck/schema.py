"""Row layouts of the engine and the orders of severities and statuses."""

from __future__ import annotations

RANGE = "struct<start_ms:bigint,end_ms:bigint>"
RANGES = f"array<{RANGE}>"
STREAM = "struct<index:bigint,kind:string,codec:string,codec_profile:string,width:bigint,height:bigint,pixel_format:string,field_order:string,frame_rate:string,time_base:string,bitrate:bigint,duration:bigint,language:string,channel_layout:string,channels:bigint,sample_rate:bigint,bit_depth:bigint,metadata:map<string,string>>"
ASSET = f"struct<id:string,path:string,fingerprint:struct<sha256:string,size_bytes:bigint>,size_bytes:bigint,modified_time:bigint,duration:bigint,streams:array<{STREAM}>>"
CONTAINER = f"struct<validity:string,format:string,bitrate_bps:bigint,duration:bigint,timestamps_contiguous:boolean,timecode_present:boolean,timestamp_gaps:{RANGES},malformed_metadata:array<string>,decode_errors:bigint>"
LUMA = "struct<min:int,max:int,mean:double,below_legal:double,above_legal:double,clipped_white:double>"
MASTERING = "struct<min_luminance_nits:double,max_luminance_nits:double,primaries_xy:array<array<double>>,white_point_xy:array<double>>"
HDR = f"struct<transfer:string,primaries:string,matrix:string,`range`:string,mastering_display:{MASTERING},max_cll:bigint,max_fall:bigint,dolby_vision:boolean>"
CLUSTER = "struct<x:bigint,y:bigint,width:bigint,height:bigint,cells:bigint,kind:string>"
DEAD_PIXELS = f"struct<frames_sampled:bigint,cells_examined:bigint,resolution_limited:boolean,dark_cells:bigint,bright_cells:bigint,flicker_cells:bigint,clusters:array<{CLUSTER}>>"
PERCEPTUAL = "struct<frames_sampled:bigint,blockiness:double,blockiness_max:double,blockiness_frames:bigint,blur:double,noise:double,flat_frames:bigint,resolution_limited:boolean>"
VIDEO = f"struct<stream_idx:bigint,frame_rate_observed:string,decoded_frame_count:bigint,decode_errors:bigint,black_frames:{RANGES},freeze_frames:{RANGES},duplicate_frames:{RANGES},luma:{LUMA},colorspace:string,field_order:string,flash:struct<transitions_ms:array<array<bigint>>>,hdr:{HDR},dead_pixels:{DEAD_PIXELS},perceptual:{PERCEPTUAL}>"
AUDIO = f"struct<stream_idx:bigint,decoded_frame_count:bigint,decode_errors:bigint,silence:{RANGES},silence_truncated:boolean,clipping_events:bigint,peak_db:double,true_peak_db:double,loudness_lufs:double,loudness_range_lu:double,phase_correlation:double,dc_offset_percent:double>"
SUBTITLE = f"struct<stream_idx:bigint,cue_count:bigint,text_decoded:boolean,invalid_durations:{RANGES},overlaps:{RANGES},malformed:{RANGES},empty_cues:{RANGES},max_gap_ms:bigint,max_line_chars:bigint,max_lines_per_cue:bigint,max_cue_duration_ms:bigint,covered_until_ms:bigint>"
TRANSCRIPT = "struct<source:string,expected_words:bigint,hypothesis_words:bigint,substitutions:bigint,deletions:bigint,insertions:bigint,wer:double,unexpected_words:array<string>,unexpected_total:bigint>"
VOICE = f"struct<stream_idx:bigint,method:string,analysed_ms:bigint,speech_analysed:boolean,speech_regions:{RANGES},speech_ms:bigint,longest_non_speech:{RANGE},speaker_turns:array<struct<speaker:string,start_ms:bigint,end_ms:bigint,confidence:float>>,speaker_count:bigint,speaker_changes:bigint,transcript:{TRANSCRIPT}>"
INSPECTION = f"struct<streams:array<{STREAM}>,container:{CONTAINER},video:array<{VIDEO}>,audio:array<{AUDIO}>,subtitle:array<{SUBTITLE}>,voice:array<{VOICE}>,diagnostics:map<string,string>>"
FIXTURE = f"asset {ASSET}, inspection {INSPECTION}"

#: frame_range and confidence are columns of a finding that no rule fills.
FINDING = f"struct<rule_id:string,status:string,severity:string,message:string,measured:string,expected:string,stream_idx:bigint,time_range:{RANGE},evidence:string>"
FINDINGS = f"array<{FINDING}>"

SEVERITIES = ["info", "warning", "error", "critical"]
#: By rank: what wins when several findings of a rule are summed up.
STATUSES = ["pass", "warn", "inconclusive", "fail"]
STREAM_KINDS = ["video", "audio", "subtitle", "data", "attachment", "unknown"]


def rank(column: str, order: list[str]) -> str:
    """SQL: the place of a value in an order, null if it has none."""
    return "CASE " + column + "".join(f" WHEN '{v}' THEN {i}" for i, v in enumerate(order)) + " END"


def severity_rank(column: str) -> str:
    return rank(column, SEVERITIES)


def status_rank(column: str) -> str:
    return rank(column, STATUSES)
