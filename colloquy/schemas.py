"""DDL of the document shapes the readers accept."""

CAPTIONS = "array<struct<text:string,start:double,duration:double>>"

ASR_RESPONSE = (
    "struct<results:struct<"
    "utterances:array<struct<start:double,end:double,speaker:int,transcript:string,confidence:double>>,"
    "channels:array<struct<alternatives:array<struct<transcript:string,"
    "words:array<struct<word:string,punctuated_word:string,start:double,end:double,speaker:int>>>>>>>>"
)

ALIGNED = (
    "struct<segments:array<struct<start:double,end:double,text:string,"
    "words:array<struct<word:string,start:double,end:double,score:double>>,"
    "speaker_raw:string,speaker:string,gender:string,speaker_role:string>>>"
)

SENTENCES = (
    "struct<unit:string,num_segments:int,error:string,"
    "segments:array<struct<speaker_id:int,speaker_label:string,start:double,end:double,transcript:string>>>"
)

SIMPLE = (
    "struct<total_segments:int,speakers:array<struct<speaker_id:int,speaker_label:string,gender:string>>,"
    "segments:array<struct<speaker_id:int,speaker_label:string,start:double,end:double,text:string,"
    "confidence:double,gender:string>>>"
)

# A raw document: `value` is one JSON document or one bounded part of it, whose
# first list item has position `offset`.
RAW_DOCUMENT = "name string, episode_id string, offset bigint, value string"

# --- fixed values: audio file extensions --------------------------------------
AUDIO_EXTENSIONS = [
    ".wav", ".mp3", ".m4a", ".aac", ".flac", ".ogg", ".opus", ".wma", ".aiff", ".aif", ".webm", ".mp4",
]
