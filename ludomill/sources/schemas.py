"""Declared schemas: persisted tables and landed payloads."""

from __future__ import annotations


GAMES = """id long, name string, release string,
    rawg_rating double, igdb_rating double, hltb_rating double, metacritic_rating double, user_rating double,
    platforms array<string>, main_story double, main_extra double, completionist double,
    cover_url array<string>, developers array<string>, publishers array<string>, description string,
    language_supports array<string>, genres array<string>, keywords array<string>"""

# One normalised catalogue hit: the game record plus what single sources add.
GAME_EXTRAS = """game_modes array<string>, game_type string, player_perspectives array<string>,
    themes array<string>, esrb_rating string, slug string"""


LANDED = "source string, query_name string, fetched_at timestamp, payload string"

_NAMED = "array<struct<name:string>>"

RAWG_SEARCH = "struct<results:array<struct<id:bigint>>>"
RAWG_DETAIL = f"""struct<id:bigint,name:string,released:string,rating:double,metacritic:double,playtime:double,
    platforms:array<struct<platform:struct<name:string>>>,genres:{_NAMED},tags:{_NAMED},
    esrb_rating:struct<name:string>,developers:{_NAMED},publishers:{_NAMED},description_raw:string>"""

IGDB_GAMES = f"""array<struct<id:bigint,name:string,game_modes:{_NAMED},game_type:struct<type:string>,
    keywords:{_NAMED},language_supports:array<struct<language:struct<name:string>>>,platforms:{_NAMED},
    player_perspectives:{_NAMED},themes:{_NAMED},rating:double,first_release_date:bigint,genres:{_NAMED},
    cover:struct<url:string>,summary:string>>"""

HLTB_GAMES = """array<struct<game_name:string,game_type:string,review_score:double,profile_platforms:array<string>,
    release_world:int,main_story:double,main_extra:double,completionist:double,similarity:double>>"""

XML_GAME = """id bigint, name string, theme array<struct<name:string>>, genre array<struct<name:string>>,
    image struct<original:string>, description string, release_date string"""
XML_REVIEW = "authors string, score double, game struct<name:string>, publish_date string"

METACRITIC_SEARCH = "struct<data:struct<items:array<struct<type:string,title:string,slug:string>>>>"
METACRITIC_PAGE = f"""struct<components:array<struct<data:struct<item:struct<title:string,releaseDate:string,
    production:struct<companies:array<struct<typeName:string,name:string>>>,genres:{_NAMED},platforms:{_NAMED},
    score:double,max:double>>>>>"""
REVIEW_SUMMARY = """struct<data:struct<item:struct<positive:array<struct<author:string>>,
    negative:array<struct<author:string>>,neutral:array<struct<author:string>>>>>"""
PROFILE_PAGE = """struct<data:struct<totalResults:bigint,items:array<struct<author:string,score:double,date:string,
    platform:string,reviewedProduct:struct<title:string,type:string>>>>>"""

# Columns kept of the four downloaded tables, with the type each is read as.
STATIC_TABLES = {
    "reviews": {
        "Review Title": "string",
        "Gaming Console name": "string",
        "Time Since Review": "string",
        "Rating/10": "double",
    },
    "hltb": {
        "name": "string",
        "platform": "string",
        "genres": "string",
        "developer": "string",
        "publisher": "string",
        "release_year": "int",
        "main_story": "double",
        "main_plus_sides": "double",
        "completionist": "double",
    },
    "metacritic": {
        "title": "string",
        "releaseDate": "string",
        "genres": "string",
        "description": "string",
        "platforms": "string",
        "metascore": "double",
        "userscore": "double",
        "developer": "string",
        "publisher": "string",
    },
    "rawg": {
        "name": "string",
        "released": "string",
        "rating": "double",
        "platforms": "string",
        "developers": "string",
        "genres": "string",
        "tags": "string",
        "publishers": "string",
        "description": "string",
        "description_raw": "string",
        "metacritic": "double",
    },
}

# Columns that must be there for a row of a static table to be kept.
STATIC_REQUIRED = {
    "reviews": ["Rating/10"],
    "hltb": ["main_story", "main_plus_sides", "completionist"],
    "metacritic": ["metascore", "userscore"],
    "rawg": [],
}
