"""URL prefixes that are not crawled, as data for operators.policy.prefix_rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: URLs whose path and all below it are left out; a parameter is not looked at
BLOCKED_URLS = """
gemini://www.youtube.com/
gemini://tictactoe.lanterne.chilliet.eu
gemini://kamalatta.ddnss.de/
gemini://tweek.zyxxyz.eu/valentina/
gemini://ansi.hrtk.in/
gemini://matrix.kiwifarms.net
gemini://songs.zachdecook.com/song.gmi.php/
gemini://songs.zachdecook.com/chord.svg/
gemini://gemini.zachdecook.com/cgi-bin/ccel.sh
gemini://cadence.moe/chapo/
gemini://nixo.xyz/reply/
gemini://nixo.xyz/notify
gemini://gemini.thebackupbox.net/queryresponse
gemini://gem.garichankar.com/share_audio
gemini://vps01.rdelaage.ovh/
gemini://mastogem.picasoft.net
gemini://runjimmyrunrunyoufuckerrun.com/fonts/
gemini://runjimmyrunrunyoufuckerrun.com/tmp/
gemini://houston.coder.town/search?
gemini://houston.coder.town/search/
gemini://marginalia.nu/search
gemini://kennedy.gemi.dev/cached?
gemini://geddit.pitr.ca/post?
gemini://geddit.pitr.ca/c/
gemini://geddit.glv.one/post?
gemini://geddit.glv.one/c/
gemini://gemini.marmaladefoo.com/cgi-bin/calc.cgi?
gemini://gemini.circumlunar.space/users/fgaz/calculator/
gemini://acidic.website/cgi-bin/weather.tcl?
gemini://caolan.uk/weather/
gemini://alexschroeder.ch/image_external
gemini://alexschroeder.ch/html/
gemini://alexschroeder.ch/diff/
gemini://alexschroeder.ch/history/
gemini://alexschroeder.ch/http
gemini://alexschroeder.ch/https
gemini://alexschroeder.ch/tag/
gemini://alexschroeder.ch/raw/
gemini://alexschroeder.ch/map/
gemini://alexschroeder.ch/do/comment
gemini://alexschroeder.ch/do/rc
gemini://alexschroeder.ch/do/rss
gemini://alexschroeder.ch/do/new
gemini://alexschroeder.ch/do/more
gemini://alexschroeder.ch/do/tags
gemini://alexschroeder.ch/do/match
gemini://alexschroeder.ch/do/search
gemini://alexschroeder.ch/do/gallery/
gemini://mozz.us/files/gemini-links.gmi
gemini://gem.benscraft.info/mailing-list
gemini://rawtext.club/~sloum/geminilist
gemini://gemini.techrights.org/
gemini://pon.ix.tc/cgi-bin/youtube.cgi?
gemini://pon.ix.tc/youtube/
gemini://taz.de/
gemini://simplynews.metalune.xyz
gemini://illegaldrugs.net/cgi-bin/news.php?
gemini://illegaldrugs.net/cgi-bin/reader
gemini://rawtext.club/~sloum/geminews
gemini://gemini.cabestan.tk/hn
gemini://hn.filiuspatris.net/
gemini://schmittstefan.de/de/nachrichten/
gemini://gmi.noulin.net/mobile
gemini://jpfox.fr/rss/
gemini://illegaldrugs.net/cgi-bin/news.php/
gemini://dw.schettler.net/
gemini://dioskouroi.xyz/top
gemini://drewdevault.com/cgi-bin/hn.py
gemini://tobykurien.com/maverick/
gemini://gemini.knusbaum.com
gemini://wp.pitr.ca/
gemini://wp.glv.one/
gemini://wikipedia.geminet.org/
gemini://wikipedia.geminet.org:1966
gemini://vault.transjovian.org/
gemini://egsam.pitr.ca/
gemini://egsam.glv.one/
gemini://gemini.conman.org/test
gemini://chat.mozz.us/stream
gemini://chat.mozz.us/submit
gemini://80h.dev/agena/
gemini://astrobotany.mozz.us/app/
gemini://carboncopy.xyz/cgi-bin/apache.gex/
gemini://gemini.susa.net/cgi-bin/search?
gemini://gemini.susa.net/cgi-bin/twitter?
gemini://gemini.susa.net/cgi-bin/vim-search?
gemini://gemini.susa.net/cgi-bin/links_stu.lua?
gemini://gemini.spam.works/textfiles/
gemini://gemini.spam.works/mirrors/textfiles/
gemini://gemini.spam.works/users/dvn/archive/
gemini://gemini.thebackupbox.net/radio
gemini://higeki.jp/radio
gemini://drewdevault.com/cgi-bin/web.sh?
gemini://gemiprox.pollux.casa/
gemini://gemiprox.pollux.casa:1966
gemini://ecs.d2evs.net/proxy/
gemini://gmi.si3t.ch/www-gem/
gemini://orrg.clttr.info/orrg.pl
gemini://mysidard.com/services/hackernews/
gemini://gem.denarii.cloud/
gemini://cfdocs.wetterberg.nu/
gemini://godocs.io
gemini://emacswiki.org/
gemini://alexschroeder.ch/
gemini://si3t.ch/code/
gemini://tilde.club/~filip/library/
gemini://gemini.bortzmeyer.org/rfc-mirror/
gemini://chris.vittal.dev/rfcs
gemini://going-flying.com/git/cgi/gemini.git/
gemini://szczezuja.flounder.online/git/
gemini://gmi.noulin.net/rfc
gemini://gmi.noulin.net/man
gemini://hellomouse.net/user-pages/handicraftsman/ietf/
gemini://tilde.team/~orichalcumcosmonaut/darcs/website/prod/
gemini://gemini.omarpolo.com/cgi
gemini://gemini.rmf-dev.com
gemini://musicbrainz.uploadedlobster.com/
gemini://gemini.lost-frequencies.eu/posts/archive
gemini://blitter.com/
gemini://ake.crabdance.com:1966/message/
gemini://iceworks.cc/z/
gemini://ake.crabdance.com:1966/channel/
gemini://gemini.autonomy.earth/posts/
gemini://lists.flounder.online/gemini/threads/messages/
gemini://tilde.pink/~bencollver/gamefaqs/
gemini://tilde.pink/~bencollver/gamefaq/
gemini://gemini.quux.org/0/Archives
gemini://gemini.rob-bolton.co.uk/songs
gemini://gthudson.xyz/cgi-bin/quietplace.cgi
gemini://futagoza.gamiri.com/gmninkle/
gemini://alexey.shpakovsky.ru/maze
gemini://jsreed5.org/live/cgi-bin/twisty/
gemini://gemini.theuse.net/
gemini://202x.moe/resonance
gemini://gmi.skyjake.fi/
gemini://warmedal.se/.well-known/
gemini://www.bonequest.com/
gemini://kennedy.gemi.dev/page-info?id=
gemini://gemi.dev/xkcd
gemini://gemi.dev/cgi-bin/
gemini://gemlog.stargrave.org/
gemini://jsreed5.org/oeis/
""".split()


def blocked_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in BLOCKED_URLS], "url string")
