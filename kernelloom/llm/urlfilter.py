"""URL verdicts: longest-match rules, and logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled table of urls (``UNWANTED`` and ``WANTED``), by a
fixed number of steps, and has a fixed number of weights, so it travels with the tasks.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS, SIZES = 1 << 13, (3, 4, 5)

#: Urls of unwanted pages and of wanted ones, written by hand, of hosts that don't exist: the model's whole
#: training table.  No table of urls served as a pattern.
UNWANTED = """
goldcasino.test/slots/spin
casino-riviera.test/welcome-bonus
www.luckycasino.test/register
vegas-slots.test/free-spins
megaslots.test/jackpot?ref=9
play-roulette.test/live-table
blackjack-online.test/deposit-bonus
poker-stars-room.test/tournament/bonus
pokerbonus.test/no-deposit
bestcasinos.test/review/top10-casino
betking.test/odds/live
bet-and-win.test/sports/bonus
sportsbet-tips.test/sure-odds
surebets.test/fixed-matches/vip
fixed-match.test/buy-tips
lotto-winner.test/claim-prize
lottery-results-win.test/jackpot
bingo-bonus.test/join
scratchcards-cash.test/win
casino.freebonus.test/claim/spins
m.slotmania.test/play-now
onlinebetting.test/signup/free-bet
crypto-casino.test/btc/bonus
games.casinowinner.test/slots
dice-bitcoin.test/bet
cheapviagra.test/order
buy-cialis.test/no-prescription
generic-meds.test/viagra-online
pharma-discount.test/buy/tramadol
online-pharmacy-rx.test/cheap-pills
pillstore.test/xanax/buy-now
www.meds-no-rx.test/order/valium
slim-pills.test/lose-weight-fast
dietpills-miracle.test/order
fatburner.test/lose-30-pounds
keto-gummies.test/free-trial
male-enhance.test/bigger-pills
enlarge-now.test/pills/order
steroids-shop.test/buy/anabolic
hgh-boost.test/buy
cbd-miracle.test/cure-all
detox-tea.test/lose-weight
botox-cheap.test/discount
hairgrowth-miracle.test/order-now
brain-pills.test/limitless-offer
freeporn.test/videos/hd
pornhive.test/watch/4471
xxxmovies.test/amateur/12
hotxxx.test/gallery/77
sexcams.test/live/girls
live-sex-chat.test/join
nude-celebs.test/photos
adultfriends.test/meet-tonight
milf-videos.test/free
teenporn-tube.test/v/99
escorts-vip.test/book-girls
erotic-massage.test/call
hookup-tonight.test/signup
sexy-singles.test/near-you
dating-hot-girls.test/join-free
camgirls.test/xxx/show
www.porn-archive.test/hd/free
adult-webcam.test/free-tokens
hentai-xxx.test/read
sexdates.test/local
payday-cash.test/apply
fastloans.test/no-credit-check
instant-loan.test/approved-now
quickcash-advance.test/apply-online
bad-credit-loans.test/guaranteed
debt-wipeout.test/free-quote
consolidate-debt-now.test/offer
credit-repair-fast.test/score-boost
cheap-insurance-quotes.test/save-now
mortgage-deal.test/lowest-rate/apply
earn-from-home.test/1000-a-day
makemoneyonline.test/secret
getrich.test/system/join-now
passive-income-now.test/free-webinar
work-at-home-cash.test/signup
millionaire-secret.test/watch-video
crypto-profits.test/invest-now
bitcoin-doubler.test/send
btc-giveaway.test/claim-now
free-crypto.test/airdrop/claim
forexrobot.test/profit/signals
binary-options-win.test/trade-now
trading-signals-vip.test/join
ico-presale.test/buy-tokens
doublecoins.test/invest/bonus
replicawatch.test/rolex-cheap
fake-rolex.test/buy
designer-replica.test/handbags/cheap
luxurybags-outlet.test/sale-90
cheapnikes.test/outlet/discount
ugg-boots-sale.test/cheap
rayban-outlet.test/90-off
jerseys-wholesale.test/cheap-nfl
discount-iphones.test/buy-cheap
cheapsoftware-oem.test/windows-key
keygen-crack.test/download
serials-warez.test/crack/photoshop
cracked-apps.test/apk/mod-free
warezforum.test/full-version-crack
free-license-keys.test/activator
nulled-scripts.test/download
torrentking.test/movie/full-hd
watch-free-movies.test/stream/hd
123stream-free.test/watch-online
full-movie-download.test/hd/free
free-mp3-download.test/album-zip
livestream-sports-free.test/watch
iptv-cheap.test/buy/12-months
modapk-hack.test/unlimited-coins
game-hacks.test/free-gems-generator
robux-generator.test/free
vbucks-free.test/claim
giftcard-generator.test/free-codes
free-giftcards.test/survey/win
amazon-voucher-win.test/claim
win-iphone.test/lucky-winner
congratulations-winner.test/claim-prize
prize-survey.test/you-won
survey-rewards.test/cash-now
luckyvisitor.test/claim?id=44
account-suspended.test/verify/login
secure-login-update.test/confirm
paypa1-verify.test/account/unlock
bank-alert-secure.test/login/confirm
appleid-locked.test/verify-now
netflix-billing.test/update-payment
webmail-quota.test/login/verify
tax-refund-claim.test/confirm/bank
parcel-fee.test/pay-now/track
wallet-connect-verify.test/seed
virus-detected.test/scan-now
pc-cleaner-free.test/download.exe
driver-updater.test/setup.exe
your-pc-infected.test/call-support
flashplayer-update.test/install.exe
adclick.test/track?c=1
popunder-ads.test/serve
bannerfarm.test/ads/728x90
click-redirect.test/go.php?u=1
trafficexchange.test/hits/free
backlinks-cheap.test/buy/1000
seo-rank-fast.test/buy-backlinks
link-exchange.test/directory/add
guestpost-cheap.test/buy-links
expired-domain-links.test/sale
buyfollowers.test/instagram/cheap
likes-cheap.test/buy/facebook
tiktok-views.test/buy/10000
youtube-subs.test/free/boost
fake-reviews.test/buy/5-star
essay-cheap.test/order-now
write-my-paper.test/buy/essay
buy-diploma.test/fake-degree
fake-passport.test/order/documents
fake-id-shop.test/buy
psychic-love.test/free-reading
spellcaster.test/bring-back-lover
horoscope-secret.test/call-now
miracle-healing.test/order
weirdtrick.test/doctors-hate
you-wont-believe.test/shocking
celebrity-shock.test/click/what-happened-next
viral-buzz.test/10-shocking-secrets
clickbait-news.test/this-one-trick
hotdeals-today.test/buy-now/limited-offer
cheap-flights-deal.test/90-off
timeshare-exit.test/free-quote
solar-free.test/claim-offer
cashback-bonus.test/signup-now
vip-offer.test/exclusive/limited
blog.mycity.test/casino-bonus-codes
forum.openfix.test/buy-cheap-viagra
www.gardenclub.test/wp-content/pills-order
news.smalltown.test/payday-loans-apply
shop.bluebird.test/replica-rolex-sale
oldschool.test/porn-videos-free
wiki.toolset.test/free-slots-bonus
library.northend.test/cheap-cialis-buy
churchband.test/xxx-cams-live
student.union4.test/buy-essay-cheap
royal-casino-club.test/vip/bonus
slotsparadise.test/play/free-spins
spin-and-win.test/wheel/claim
roulette-system-win.test/buy
texas-poker-bonus.test/play
online-bingo-cash.test/signup-bonus
betting-tips-sure.test/vip/join
football-fixed-bets.test/buy-odds
casino-bonuscodes.test/2020/free-chips
livecasino-dealer.test/play-now
jackpot-slots-free.test/download-app
gamble-btc.test/dice/deposit
bonus-sportsbook.test/bet/odds
lottowin-cash.test/prize
casinos-without-license.test/list/best
cheap-pills-rx.test/order/viagra
viagra-cialis-levitra.test/buy
tramadol-overnight.test/no-prescription
order-xanax.test/cheap
discount-pharmacy24.test/buy-pills
weightloss-pills-fast.test/free-trial
bigger-longer.test/enlarge/pills
testosterone-boost.test/order-now
anabolic-steroids.test/cheap/buy
cannabis-gummies-buy.test/order
miracle-cream.test/free-trial/order
rxmeds-cheap.test/pharmacy/discount
hotporn-tube.test/xxx/videos
free-sex-videos.test/watch/hd
nudegirls-cam.test/live/free
xxx-hd-tube.test/amateur
adultsex-finder.test/join/local
sexy-milfs.test/dating/tonight
pornstars-hd.test/video/9921
escort-girls-city.test/book/vip
naked-teens-xxx.test/photos
camsex-live.test/chat/girls
eroticvideos.test/free/watch
nakedcelebs-xxx.test/gallery
localsluts.test/signup/free
hardcore-porn.test/download
fast-cash-loan.test/apply-now
payday-loans-online.test/no-credit-check/apply
cash-advance-today.test/approved
loan-bad-credit-ok.test/apply
instant-cash-now.test/offer
cheap-car-insurance-quote.test/free-quote
debt-relief-free.test/apply-now
creditcard-approved.test/instant/offer
make-money-fast.test/join/free
easy-cash-system.test/secret/webinar
earn-1000-daily.test/signup-now
get-rich-crypto.test/profit
bitcoin-profit-robot.test/join-now
crypto-airdrop-free.test/claim-now
btc-doubler-invest.test/deposit
forex-signals-profit.test/vip/join
free-bitcoin-generator.test/claim
trading-robot-cash.test/free/signup
invest-bonus-coin.test/presale/buy
token-presale-now.test/buy
rolex-replica-watches.test/cheap/sale
replica-handbags-cheap.test/outlet
outlet-nike-cheap.test/sale/discount
cheap-jerseys-outlet.test/buy-now
fake-designer-shoes.test/discount
sunglasses-outlet90.test/sale-90-off
cheap-iphone-deals.test/buy-now
oem-software-cheap.test/download/key
photoshop-crack-free.test/download
windows-keygen.test/activator/free
warez-downloads.test/full/crack
crack-serial-keys.test/free-download
apk-mod-cracked.test/unlimited/free
free-movies-stream.test/watch/full-hd
torrent-movies-hd.test/download/free
watch-series-free.test/stream/online
mp3-albums-free.test/download-zip
iptv-free-stream.test/watch/live
game-cheats-hack.test/unlimited/generator
free-gems-hack.test/generator/claim
coins-generator-free.test/hack
free-voucher-codes.test/claim/survey
win-a-giftcard.test/survey/claim
winner-prize-claim.test/lucky
you-won-iphone.test/claim-prize
lucky-survey-cash.test/win/reward
verify-account-login.test/confirm/secure
secure-bank-verify.test/login
login-update-billing.test/verify/account
account-locked-alert.test/unlock/confirm
paypal-secure-confirm.test/login/verify
wallet-verify-now.test/connect/confirm
parcel-pay-fee.test/confirm/payment
update-your-payment.test/secure/login
virus-scan-alert.test/download/cleaner.exe
pc-speed-cleaner.test/free/setup.exe
free-driver-update.test/download.exe
infected-alert.test/call-now/support
ads-click-track.test/redirect?c=7
pop-ads-network.test/click/serve
redirect-traffic.test/go/click?u=9
cheap-seo-backlinks.test/buy/500
buy-traffic-hits.test/cheap/order
link-farm-seo.test/add/free
rank-first-seo.test/buy-links
buy-instagram-likes.test/cheap/followers
followers-cheap-fast.test/buy/1000
youtube-views-buy.test/cheap/order
buy-fake-reviews.test/order-now
cheap-essay-writers.test/order/now
buy-essay-online.test/cheap-paper
diploma-fake-buy.test/order
buy-fake-id.test/passport/order
free-psychic-love.test/call/now
love-spells-fast.test/order
shocking-celebs.test/you-wont-believe/click
doctors-shocked.test/weird-trick
10-secrets-shocking.test/viral/click
one-weird-trick.test/belly-fat
hot-deals-cheap.test/limited-offer/buy
limited-offer-sale.test/buy-now/discount
free-trial-offer.test/claim/now
vip-bonus-signup.test/join-free
forum.rowers.test/casino-free-spins
blog.pastrychef.test/cheap-viagra-order
www.villagehall.test/porn-free-xxx
wiki.mathclub.test/payday-cash-loan
news.harbourtown.test/replica-watches-cheap
school.eastside.test/buy-essay-now
choir.oldminster.test/slots-bonus-casino
gallery.smallpots.test/xxx-sex-cams
"""
WANTED = """
meteo-atlas.test/forecast/week
riverwatch.test/levels/2021
tidetables.test/harbour/march
seismology-institute.test/catalogue/1994
glacier-survey.test/reports/summer
botanic-garden.test/collections/ferns
birdcount.test/species/heron
mushroom-guide.test/identify/chanterelle
insectarium.test/beetles/stag
oceanlab.test/expeditions/2019
www.stone-museum.test/exhibits/fossils
city-archive.test/letters/1911
maps.oldtown.test/1850/parish
national-library.test/catalogue/manuscripts
folklore-society.test/tales/miller
physics-dept.test/courses/optics
lectures.westuni.test/algebra/rings
chemistry-notes.test/lab/titration
mathforum.test/proofs/primes
statistics-handbook.test/regression/diagnostics
journal-linguistics.test/volume/12/syntax
openarchive.test/paper/7731
theses.northuni.test/2016/hydrology
history-review.test/articles/treaty-1648
philosophy-pages.test/kant/ethics
docs.fastparse.test/install/linux
api.gridtools.test/reference/index
compiler-notes.test/lexer/tokens
kernelhandbook.test/scheduler/queues
database-primer.test/joins/hash
git.sourcehouse.test/project/readme
bugs.openfix.test/ticket/4182
wiki.toolset.test/build/cmake
lists.netmail.test/archive/2009-04
changelog.editorapp.test/release-3
blog.slowcode.test/posts/pointers
notes.tinyweb.test/css/layout
forum.bikefix.test/thread/brake-pads
answers.homelab.test/question/router
tutorials.pixelpaint.test/layers
recipes.kitchenbook.test/bread/rye
soups.homecook.test/lentil
www.cheesemakers.test/blue/ageing
tea-tasting.test/oolong/notes
jamandpreserve.test/plum
garden-almanac.test/roses/pruning
allotment-diary.test/june/beans
beekeepers.test/hives/winter
orchard-trust.test/apples/varieties
lawnandhedge.test/advice/soil
trail-maps.test/north-ridge/day-2
alpine-club.test/huts/booking-rules
cycling-routes.test/coast/stage-4
canoe-guide.test/rivers/upper
railway-timetable.test/line/7
bus.mycity.test/routes/14
ferry-times.test/islands/west
airport-history.test/terminals
travel-diary.test/lisbon/day1
youthhostels.test/locations/lake
council.smalltown.test/minutes/2019
www.mycity.test/services/recycling
planning.northend.test/applications/2020-114
parish-newsletter.test/june
library.northend.test/opening-hours
fire-service.test/safety/smoke-alarms
police-records.test/history/1930
court-decisions.test/2017/appeal
statutes.lawhouse.test/tenancy/section-4
parliament-watch.test/debates/water
primary-school.test/term-dates
highschool-band.test/concerts/spring
student.union4.test/societies/chess
adult-education.test/courses/pottery
teachers-forum.test/lesson-plans/fractions
hospital-trust.test/departments/cardiology
nursing-notes.test/wound-care
vaccination-info.test/schedule/children
dentist-advice.test/gum-disease
mental-health-guide.test/anxiety/help
medical-encyclopedia.test/liver
pharmacology-text.test/chapter/antibiotics
nutrition-council.test/guidelines/fibre
sleep-research.test/studies/apnea
public-health.test/reports/measles
economics-papers.test/inflation/1970s
statistics-office.test/tables/population
central-bank.test/publications/bulletin
tax-office.test/forms/guide
budget-explained.test/2022/spending
pension-advice.test/retirement/state
savings-guide.test/accounts/interest
insurance-law.test/marine/history
trade-union.test/news/agreement
consumer-rights.test/refunds/guide
news.dailyherald.test/world/election
news.smalltown.test/local/bridge-repair
weekly-gazette.test/2021/05/harvest
radio-north.test/schedule/morning
press-council.test/rulings/2018
sports.dailyherald.test/football/report
athletics-club.test/results/10k
chess-federation.test/ratings/june
tennis-juniors.test/fixtures
rowing-club.test/regatta/heats
cricket-scorebook.test/season/1998
swimming-pool.test/lanes/timetable
climbing-wall.test/beginners
ski-patrol.test/avalanche/bulletin
sailing-school.test/knots/bowline
poetry-archive.test/sonnets/18
novel-readers.test/reviews/winter
theatre-royal.test/programme/spring
film-society.test/festival/2018
opera-guide.test/acts/figaro
string-quartet.test/scores/haydn
jazz-records.test/1959/sessions
piano-lessons.test/scales/minor
churchband.test/hymns/evening
choir-festival.test/programme
watercolour.test/lessons/skies
photo-darkroom.test/developing/film
pottery-studio.test/glazes/ash
architecture-review.test/bridges/stone
typeface-history.test/garamond
astronomy-club.test/observing/saturn
space-agency.test/missions/comet
telescope-makers.test/mirrors/grinding
climate-data.test/stations/precipitation
energy-institute.test/wind/report
engineering-toolbox.test/beams/deflection
woodworking-notes.test/joints/dovetail
clock-repair.test/escapements
model-railways.test/layouts/n-gauge
radio-amateur.test/antennas/dipole
www.gardenclub.test/meetings/may
shop.bluebird.test/books/gardening
bookshop-lane.test/catalogue/maps
hardware-store.test/screws/metric
fabric-shop.test/linen/natural
vineyard-visit.test/tours/harvest
farm-dairy.test/cheese/cheddar
village-bakery.test/menu/lunch
restaurant-harbour.test/dinner/menu
hotel-lakeside.test/rooms/double
animal-shelter.test/adopt/dogs
vet-advice.test/cats/diet
horse-riding.test/stables/lessons
aquarium-keepers.test/water/hardness
wildlife-rescue.test/hedgehog
charity-water.test/volunteers/wells
foodbank.test/donate/items
scouts-district.test/camps/summer
red-lamp-theatre.test/history
oldschool.test/reunion/1985
genealogy-records.test/census/1881
heraldry-guide.test/shields
language-course.test/spanish/lesson-3
dictionary-online.test/words/heath
translation-journal.test/issue/22
jobs.university-post.test/lecturer/vacancy
careers-advice.test/interview/questions
apprenticeships.test/electrician
patents-search.test/1903/engine
standards-body.test/drafts/17
fr.atelier-bois.test/outils/rabot
de.wanderwege.test/harz/brocken
es.cocina-casera.test/recetas/sopa
it.giardino.test/rose/potatura
nl.fietsroutes.test/kust
meteo.ville-haute.test/previsions
stadtbibliothek.test/katalog/karten
museo-naval.test/salas/cartas
musee-horloge.test/visites/groupes
gemeinde-tal.test/sitzung/2019
mail-history.test/stamps/penny
coin-collectors.test/roman/denarius
toy-museum.test/tin/trains
lighthouse-list.test/north-sea
canal-trust.test/locks/flight
mybank-museum.test/history/ledger
security-research.test/advisories/tls
password-guide.test/choosing
linux-users.test/login/shell-history
virus-biology.test/influenza/structure
game-theory.test/nash/proof
probability-notes.test/dice/expectation
card-games-rules.test/whist
puzzle-club.test/crossword/monthly
boardgame-reviews.test/strategy/go
volcano-observatory.test/bulletins/etna
rainfall-maps.test/monthly/april
coral-reef-survey.test/transects/2015
herbarium.westuni.test/specimens/mosses
butterfly-atlas.test/families/blues
geology-fieldtrips.test/limestone/caves
soil-survey.test/profiles/peat
marine-biology.test/notes/plankton
forest-research.test/plots/beech
museum-of-science.test/engines/steam
town-archive.test/maps/1790
record-office.test/wills/1742
manuscripts.oldlibrary.test/psalter
medieval-history.test/monasteries/charters
archaeology-unit.test/digs/roman-villa
oral-history.test/interviews/miners
university-press.test/catalogue/history
algebra-notes.test/groups/cosets
geometry-course.test/circles/theorem
calculus-lectures.test/week-4/limits
physics-demos.test/pendulum
organic-chemistry.test/reactions/esters
biology-school.test/cells/mitosis
linguistics-lab.test/phonetics/vowels
philosophy-forum.test/ethics/duty
economics-dept.test/seminars/spring
thesis-repository.test/2011/geography
journal-of-botany.test/volume/40/roots
conference-proceedings.test/2018/session-3
open-textbook.test/statistics/chapter-5
manual.mailserver.test/configuration
docs.plotlib.test/guide/axes
reference.langspec.test/types/records
developer.mapkit.test/tutorial/tiles
source.tinykernel.test/tree/drivers
issues.webserver.test/4471
wiki.networking.test/dns/records
mailing-list.compilers.test/2012/june
blog.datamodel.test/posts/indexes
notes.unixtools.test/awk/fields
forum.woodturners.test/thread/lathe
questions.gardeners.test/tomato/blight
handbook.sysadmin.test/backups
release-notes.sheetapp.test/2.4
howto.electronics.test/resistors
bread-baking.test/sourdough/starter
family-recipes.test/stew/barley
vegetarian-kitchen.test/beans/soup
pasta-handbook.test/shapes/orecchiette
coffee-roasters.test/guide/grinding
wine-regions.test/loire/whites
herb-garden.test/thyme/growing
hedgerow-guide.test/hawthorn
pond-life.test/newts
apple-growers.test/pruning/winter
hill-walks.test/routes/ridge
mountain-rescue.test/reports/2016
long-distance-paths.test/stage-9
kayak-club.test/trips/estuary
tram-history.test/lines/1920
coach-timetables.test/route/31
harbour-authority.test/notices/mariners
travel-notes.test/kyoto/temples
walking-holidays.test/islands/advice
campsites-guide.test/lakes/map
district-council.test/meetings/agenda
county-planning.test/documents/2018
parish-church.test/services/sunday
community-centre.test/activities/week
town-library.test/events/reading
water-board.test/quality/report
road-safety.test/schools/crossing
appeal-court.test/judgments/2014
land-law.test/leases/notes
senate-records.test/1966/hearings
village-school.test/uniform/policy
college-music.test/ensembles/wind
university-chess.test/league/results
evening-classes.test/drawing/term-2
physics-teachers.test/worksheets/heat
childrens-hospital.test/wards/visiting
physiotherapy-advice.test/knee/exercises
first-aid-guide.test/burns
eye-clinic.test/glaucoma/leaflet
diabetes-society.test/diet/advice
nursing-college.test/modules/ethics
epidemiology-notes.test/cohort/bias
food-standards.test/labelling/rules
heart-research.test/trials/summary
allergy-advice.test/pollen/calendar
labour-statistics.test/wages/1960
trade-figures.test/exports/quarter-2
national-accounts.test/tables/annual
revenue-service.test/forms/instructions
household-budget.test/survey/results
housing-association.test/tenants/handbook
consumer-council.test/complaints/process
evening-post.test/2017/harbour/strike
county-times.test/news/flood-warning
morning-radio.test/programmes/monday
foreign-desk.test/reports/summit
science-weekly.test/2013/comets
local-history-news.test/winter/issue-8
county-cricket.test/scorecards/1987
fell-running.test/races/results
gymnastics-club.test/timetable
bowls-league.test/fixtures/division-2
skating-club.test/lessons/children
swim-coach.test/drills/backstroke
sea-scouts.test/sailing/badges
short-stories.test/authors/chekhov
book-group.test/discussion/autumn
playwrights.test/drafts/act-two
amateur-theatre.test/rehearsals
silent-films.test/directors/murnau
folk-songs.test/ballads/sea
organ-recitals.test/programme/bach
brass-band.test/contests/2009
guitar-makers.test/bracing/spruce
life-drawing.test/charcoal/hands
printmaking.test/etching/plates
quilting-guild.test/patterns/stars
stained-glass.test/restoration/windows
church-architecture.test/naves/vaults
calligraphy.test/italic/strokes
planet-watch.test/jupiter/moons
meteor-section.test/perseids/counts
rocket-history.test/engines/1944
hydro-power.test/turbines/maintenance
bridge-engineers.test/journal/cables
concrete-institute.test/testing/cores
furniture-makers.test/chairs/windsor
watch-collectors.test/movements/lever
steam-railway.test/timetable/summer
shortwave-radio.test/receivers/notes
knitting-patterns.test/sleeves/cable
ironmonger.test/hinges/brass
bakery-lane.test/menu/saturday
seaside-hotel.test/rooms/garden-view
village-inn.test/history
sheepdog-trials.test/rules
bird-hospital.test/owls/release
lifeboat-station.test/launches/2012
blood-donors.test/sessions/venues
youth-orchestra.test/auditions
family-history.test/surnames/smith
esperanto-lessons.test/unit-6
latin-dictionary.test/verbs/ferre
translators-guild.test/glossary/law
job-centre.test/training/welding
trade-marks.test/register/1925
de.heimatverein.test/chronik/1880
de.fahrradwege.test/elbe/etappe-2
fr.jardins-publics.test/plantes/iris
fr.bibliotheque-nord.test/catalogue/cartes
es.senderos.test/sierra/ruta-3
es.museo-tejidos.test/salas
it.cucina-nonna.test/minestra
it.archivio-storico.test/lettere/1790
nl.stadsarchief.test/kaarten
pt.receitas-da-serra.test/sopas
pl.ogrod-botaniczny.test/kolekcje
se.fjallvandring.test/leder
stamps-society.test/penny/varieties
windmill-trust.test/sails/repair
canal-boats.test/restoration/diary
banking-history.test/notes/1830
cryptography-course.test/lectures/ciphers
web-security-notes.test/login/sessions
credit-unions-history.test/founders
sex-education-school.test/lesson/biology
gambling-research.test/papers/addiction
pharmacy-history.test/jars/labels
dice-probability.test/problems/sums
free-software-notes.test/licences
insurance-history.test/marine/ledgers
insect-viruses.test/papers/baculovirus
"""


def labelled(unwanted: str = UNWANTED, wanted: str = WANTED) -> tuple[tuple[str, str, int], ...]:
    """(host, path, 1 for unwanted) of each line."""
    made = []
    for lines, label in ((unwanted, 1), (wanted, 0)):
        for line in lines.split():
            host, slash, path = line.partition("/")
            made.append((host, slash + path.partition("?")[0], label))
    return tuple(made)


LABELLED = labelled()


def held_out(table: tuple[tuple[str, str, int], ...]) -> tuple[list, list]:
    """(four fifths, the rest) by the urls' crc32, to measure a model on what it hasn't seen."""
    rest = [r for r in table if zlib.crc32((r[0] + r[1]).encode()) % 5 == 0]
    return [r for r in table if r not in rest], rest


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def grams(host: str, path: str) -> np.ndarray:
    """Hashed weights of the n-grams of ``^host$`` and ``^path$``; the two don't share n-grams."""
    at = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            at |= {zlib.crc32(f"{kind}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % WEIGHTS for i in range(len(text) - n + 1)}
    return np.array(sorted(at), np.int64)


def features(table: tuple[tuple[str, str, int], ...]) -> np.ndarray:
    """A row of unit norm for each url."""
    x = np.zeros((len(table), WEIGHTS))
    for i, (host, path, _) in enumerate(table):
        own = grams(host, path)
        x[i, own] = 1 / np.sqrt(max(1, len(own)))
    return x


def descend(k: np.ndarray, y: np.ndarray, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """(coefficients of the rows, bias) by gradient descent on the ridge-penalised logistic loss, from the rows'
    products k: the weights are sums of rows, so the descent needs no more than these."""
    a, b = np.zeros(len(y)), 0.0
    for _ in range(rounds):
        d = (1 / (1 + np.exp(-(k @ a + b))) - y) / len(y)
        a -= rate * 8 * (d + decay * a)
        b -= rate * d.sum()
    return a, b


def cut_by_folds(x: np.ndarray, y: np.ndarray, table: tuple[tuple[str, str, int], ...], folds: int = 5, **steps) -> float:
    """The logit at which the lesser of both classes' recalls is largest, over scores that each url gets from a
    model of the other folds; the middle of the best range."""
    fold, k, out = np.array([zlib.crc32((h + p).encode()) // 5 % folds for h, p, _ in table]), x @ x.T, np.zeros(len(y))
    for f in range(folds):
        own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if len(own) and len(rest):
            a, b = descend(k[np.ix_(rest, rest)], y[rest], **steps)
            out[own] = k[np.ix_(own, rest)] @ a + b
    at = np.sort(out)
    cuts = (at[:-1] + at[1:]) / 2
    worst = np.minimum(((out[None] >= cuts[:, None]) & (y == 1)).sum(1) / max(1, (y == 1).sum()), ((out[None] < cuts[:, None]) & (y == 0)).sum(1) / max(1, (y == 0).sum()))
    return float(np.median(cuts[worst == worst.max()])) if len(cuts) else 0.0


@functools.lru_cache(4)
def train(table: tuple[tuple[str, str, int], ...] = LABELLED, rounds: int = 600, rate: float = 1.0, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, bias) of the logistic regression; the bias is moved so that a score of 0.5 is the cut that
    cross-validation within the table finds."""
    x, y = features(table), np.array([label for *_, label in table], float)
    steps = {"rounds": rounds, "rate": rate, "decay": decay}
    a, b = descend(x @ x.T, y, **steps)
    return x.T @ a, b - cut_by_folds(x, y, table, **steps)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path up to ``?``, ``#`` or the end.  Null, or without ``://``: both empty."""
    pattern = r"^(?s).*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    lower = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(text, pattern, 2)


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, table: tuple[tuple[str, str, int], ...] = LABELLED, cut: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's, from 0 to 1; higher: unwanted).

    A null or malformed url has an empty host and path, no rule, and is allowed.  A very long url is judged
    whole.  Of rules that fit, the longest counts, and of equally long ones the last by its text.  Repeated
    rows repeat; a null id stays null; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    w, b = train(table)
    w = w.astype(np.float32)

    @F.pandas_udf("double")
    def scores(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        out = np.empty(len(hosts))
        for i, (host, path) in enumerate(zip(hosts, paths)):
            own = grams(host, path)
            out[i] = w[own].sum() / np.sqrt(max(1, len(own))) + b if host else -35.0
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("score", scores("host", "path"))
    own = F.when(F.col("score") >= cut, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
